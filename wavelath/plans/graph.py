"""Graphs of components: JSON in, lazy DataFrames out.

A component has a kind of rows that it takes and one that it gives; connections
whose kinds differ are refused before anything runs. Global properties fill those
that a component has under the same name and doesn't set itself.

Over a streaming source the same graph is a streaming query: run() starts it, a sink ends it
at its byte limit. Spark keeps the state of one such operator a query, so of framing and smoothing
a stream does one; the other takes the first one's written rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.convert import FLOATS
from ..operators import framing, histogram, sinks, smoothing, spectral


@dataclass(frozen=True)
class Component:
    """build(inputs, properties, dtype) -> DataFrame; takes and gives: dtype -> kind of rows, None for no port."""

    name: str
    build: Callable[[SparkSession, DataFrame | None, dict[str, Any], str], DataFrame]
    takes: Callable[[str], str | None]
    gives: Callable[[str], str | None]
    defaults: dict[str, Any] = field(default_factory=dict)
    dtypes: tuple[str, ...] = ()
    #: Of a sink: its input to rows (channel, order, data), and the column of the order.
    data: Callable[[DataFrame], DataFrame] | None = None
    #: Whether it holds state over a stream, by its properties.
    stateful: Callable[[dict[str, Any]], bool] = lambda _: False
    order: str = "seq"


REGISTRY: dict[str, Component] = {}


def register(component: Component) -> Component:
    """Makes a component known by its name; the way to add one's own."""
    REGISTRY[component.name] = component
    return component


def _real(dtype: str) -> str:
    return "frames:" + dtype.removeprefix("c")


def _complex(dtype: str) -> str:
    return "frames:c" + dtype.removeprefix("c")


def _replay(spark, _, p, dtype):
    from ..sources.replay import replay

    return replay(spark, p["path"], p["streaming"])


def _udp(spark, _, p, dtype):
    from ..sources.udp import read_udp

    return read_udp(spark, **p)


def _stov(spark, df, p, dtype):
    if df.isStreaming:
        from ..streaming import stateful

        return stateful.stov(df, p["output_size"], p["transport"], p["byteswap"], dtype)
    return framing.stov(df, p["output_size"], p["transport"], dtype, p["byteswap"])


def _smooth(spark, df, p, dtype):
    value = "psd" if "psd" in df.columns else "x"
    if df.isStreaming:
        from ..streaming import stateful

        return stateful.exp_smooth(df, p["alpha"], value, dtype)
    return smoothing.exp_smooth(df, p["alpha"], value, dtype)


def _histogram(spark, df, p, dtype):
    options = (p["msg_size"], p["num_msgs"], p["adc_bits"], p["sample_rate"], p["transport"], p["byteswap"])
    if df.isStreaming:
        from ..streaming import stateful

        return stateful.histogram(df, *options)
    return histogram.from_packets(df, *options)


def _limited(data: Callable[[DataFrame], DataFrame], order: str):
    """A sink's rows: up to its limit in batch; of a stream all, as the limit holds over micro-batches."""
    return lambda spark, df, p, dtype: data(df) if df.isStreaming else sinks.limited(data(df), p["num_bytes"], seq=order)


def _none(_):
    return None


_packets = lambda _: "packets"
_F = ("f32", "f64")
register(Component("replay_source", _replay, _none, _packets, {"path": "", "streaming": False}))
register(Component("udp_source", _udp, _none, _packets, {"interface": "", "ip_addr": "", "port": 0, "recv_buf_size": 0xFFFF, "msg_size": 0, "num_msgs": 0}))
register(Component("stov", _stov, _packets, lambda t: "frames:" + t, {"output_size": 0, "transport": "", "byteswap": True, "msg_size": 0}, tuple(FLOATS), stateful=lambda _: True))
register(Component("fft", lambda s, d, p, t: spectral.fft(d, p["fft_size"], p["window"], p["shift"], t, p["fftw_threads"]), _complex, _complex, {"window": "", "fft_size": 1024, "fftw_threads": 1, "shift": True}, _F))
register(Component("psd", lambda s, d, p, t: spectral.psd(d, p["fft_size"], p["window"], p["sample_rate"], t), _complex, _real, {"window": "", "fft_size": 1024, "sample_rate": 1.0}, _F))
register(Component("exp_smooth", _smooth, _real, _real, {"alpha": 1.0}, _F, stateful=lambda p: p["alpha"] != 1))
register(Component("histogram", _histogram, _packets, lambda _: "histogram", {"transport": "", "msg_size": 0, "byteswap": True, "adc_bits": 0, "sample_rate": 0, "num_msgs": 64}))
register(Component("file_writer", _limited(sinks.payloads, "seq"), _packets, _none, {"filename": "", "num_bytes": 0}, (), sinks.payloads))
register(Component("aligned_mem_writer", _limited(sinks.memory, "frame"), lambda t: "frames:" + t, _none, {"filename": "", "num_bytes": 0}, tuple(FLOATS), sinks.memory, "frame"))


class GraphError(ValueError):
    """A specification that can't be run."""


@dataclass
class Node:
    component: Component
    dtype: str
    properties: dict[str, Any]
    upstream: str | None = None


class Graph:
    """Components and their connections, checked; build() gives the DataFrame at any of them."""

    def __init__(self, spec: dict):
        self.name = spec.get("name", "")
        shared = {p["name"]: p["value"] for p in spec.get("properties", [])}
        self.nodes: dict[str, Node] = {}
        for c in spec["components"]:
            kind = c.get("component", c["name"])
            if kind not in REGISTRY:
                raise GraphError(f"unknown component {kind!r}")
            comp = REGISTRY[kind]
            dtype = c.get("create_arg", comp.dtypes[-1] if comp.dtypes else "")
            if comp.dtypes and dtype not in comp.dtypes:
                raise GraphError(f"{kind} has no type {dtype!r}")
            own = {p["name"]: p["value"] for p in c.get("properties", [])}
            if unknown := set(own) - set(comp.defaults):
                raise GraphError(f"{kind} has no properties {sorted(unknown)}")
            self.nodes[c["name"]] = Node(comp, dtype, {k: own.get(k, shared.get(k, v)) for k, v in comp.defaults.items()})
        for link in spec.get("connections", []):
            self._connect(link["output"], link["input"])
        for name in self.nodes:
            self._path(name)

    @classmethod
    def from_json(cls, text: str) -> Graph:
        return cls(json.loads(text))

    def _connect(self, out: dict, into: dict) -> None:
        for end, port in ((out, "data_out"), (into, "data_in")):
            if end["component"] not in self.nodes:
                raise GraphError(f"unknown component {end['component']!r}")
            if end["port"] != port:
                raise GraphError(f"{end['component']} has no port {end['port']!r}")
        a, b = self.nodes[out["component"]], self.nodes[into["component"]]
        given, taken = a.component.gives(a.dtype), b.component.takes(b.dtype)
        if given is None or given != taken:
            raise GraphError(f"{out['component']} gives {given}, {into['component']} takes {taken}")
        if b.upstream:
            raise GraphError(f"{into['component']} has two inputs")
        b.upstream = out["component"]

    def _path(self, name: str) -> list[str]:
        path = [name]
        while up := self.nodes[path[-1]].upstream:
            if up in path:
                raise GraphError(f"a cycle at {up}")
            path.append(up)
        return path[::-1]

    def build(self, spark: SparkSession, name: str | None = None, source: DataFrame | None = None) -> DataFrame:
        """The rows that a component gives, the last one by default; source stands in for the first component of the path."""
        name = name or list(self.nodes)[-1]
        df, held = source, None
        for step in self._path(name)[source is not None :]:
            node = self.nodes[step]
            if df is not None and df.isStreaming and node.component.stateful(node.properties):
                if held:
                    raise GraphError(f"{held} and {step} both hold state: write the rows of {held} and stream them to {step}")
                held = step
            if df is None and node.component.takes(node.dtype):
                raise GraphError(f"{step} has no input")
            df = node.component.build(spark, df, node.properties, node.dtype)
        return df

    def run(self, spark: SparkSession, name: str | None = None, source: DataFrame | None = None, checkpoint: str | None = None) -> DataFrame | StreamingQuery:
        """build, and write to the component's filename if it is a sink.

        Over a streaming source: the started query of a sink, which ends at the byte limit, or the streaming rows of any other component.
        """
        name = name or list(self.nodes)[-1]
        df, node = self.build(spark, name, source), self.nodes[name]
        if not (path := node.properties.get("filename")):
            return df
        if df.isStreaming:
            # The stream's rows come in as its micro-batches, already cut down to channel, order and data.
            return sinks.Capture(lambda rows: rows, path, node.properties["num_bytes"], node.component.order).start(df, checkpoint)
        sinks.write_raw(df, path)
        return df
