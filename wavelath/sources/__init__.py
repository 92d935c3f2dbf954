"""Sources of packets: datagrams from a socket, and replay of stored ones."""
