"""Datagrams as a streaming source (format "wavelath_udp").

One row per datagram: channel, seq, pkt, recv_sec, recv_ps; recv_ps are true
picoseconds. Datagrams are held until their batch is committed, so a batch can be
read again; what was not committed is lost with the driver, as on any socket.
"""

from __future__ import annotations

import socket
import struct
import time

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "channel string, seq long, pkt binary, recv_sec long, recv_ps long"


def is_multicast(address: str) -> bool:
    return bool(address) and 224 <= int(address.split(".")[0]) <= 239


def interface_ip(interface: str) -> str:
    """IPv4 address of a network interface; empty if it has none."""
    import fcntl

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        try:
            reply = fcntl.ioctl(s.fileno(), 0x8915, struct.pack("256s", interface.encode()[:15]))
        except OSError:
            return ""
    return socket.inet_ntoa(reply[20:24])


def open_socket(interface: str, ip_addr: str, port: int, recv_buf_size: int) -> socket.socket:
    """A bound, non-blocking socket; a multicast group is joined on the interface's address."""
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
    s.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, recv_buf_size)
    own = interface_ip(interface) if interface else ""
    if is_multicast(ip_addr):
        s.bind(("", port))
        s.setsockopt(socket.IPPROTO_IP, socket.IP_ADD_MEMBERSHIP, socket.inet_aton(ip_addr) + socket.inet_aton(own or "0.0.0.0"))
    else:
        s.bind((ip_addr, port))
    s.setblocking(False)
    return s


class Receiver:
    """Takes batches of datagrams; a longer one is cut to msg_size."""

    def __init__(self, channel: str = "0", interface: str = "", ip_addr: str = "", port: int = 0, recv_buf_size: int = 0xFFFF, msg_size: int = 0, num_msgs: int = 0):
        if msg_size <= 0 or num_msgs <= 0:
            raise ValueError("msg_size and num_msgs must be positive")
        self.channel, self.msg_size, self.num_msgs = channel, msg_size, num_msgs
        self.socket = open_socket(interface, ip_addr, port, recv_buf_size)
        self.held: dict[int, tuple] = {}

    def receive(self, seq: int, wait: float = 1.0) -> int:
        """Holds up to num_msgs more datagrams from number seq on; the next number."""
        end, until = seq, time.monotonic() + wait
        while end < seq + self.num_msgs:
            try:
                data = self.socket.recv(self.msg_size)
            except BlockingIOError:
                if end > seq or time.monotonic() > until:
                    break
                time.sleep(0.005)
                continue
            now = time.time_ns()
            self.held[end] = (self.channel, end, data, now // 10**9, now % 10**9 * 1000)
            end += 1
        return end


class UdpReader(SimpleDataSourceStreamReader):
    """Spark copies the reader to plan with; only the one that is asked for datagrams opens the socket."""

    def __init__(self, options: dict):
        number = lambda k, d: int(options.get(k, d))
        self.options = (options.get("channel", "0"), options.get("interface", ""), options.get("ip_addr", ""), number("port", 0), number("recv_buf_size", 0xFFFF), number("msg_size", 0), number("num_msgs", 0))
        self.opened: Receiver | None = None

    def __getstate__(self) -> dict:
        return {"options": self.options, "opened": None}

    @property
    def receiver(self) -> Receiver:
        if self.opened is None:
            self.opened = Receiver(*self.options)
        return self.opened

    def initialOffset(self) -> dict:
        _ = self.receiver  # listens from the start of the query on
        return {"seq": 0}

    def read(self, start: dict):
        end = self.receiver.receive(start["seq"])
        return iter([self.receiver.held[k] for k in range(start["seq"], end)]), {"seq": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        held = self.opened.held if self.opened else {}
        return iter([held[k] for k in range(start["seq"], end["seq"]) if k in held])

    def commit(self, end: dict) -> None:
        if self.opened:
            self.opened.held = {k: v for k, v in self.opened.held.items() if k >= end["seq"]}


class UdpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wavelath_udp"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> UdpReader:
        return UdpReader(dict(self.options))


def read_udp(spark, **options):
    """Streaming DataFrame of datagrams; options as the source's properties."""
    spark.dataSource.register(UdpSource)
    return spark.readStream.format("wavelath_udp").options(**{k: str(v) for k, v in options.items()}).load()
