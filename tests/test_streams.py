"""Packets, kernels, frames, smoothing, histograms, sinks, graphs and the socket source."""

import itertools
import socket
import struct
import threading
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelath.functions import convert as C
from wavelath.functions import packets as P
from wavelath.functions import spectral as S
from wavelath.operators import framing, histogram, sinks, smoothing, spectral
from wavelath.plans.graph import REGISTRY, Graph, GraphError
from wavelath.queries import PSD_GRAPH
from wavelath.sources import udp
from wavelath.streaming import stateful

PACKETS = "channel string, seq long, pkt binary, recv_sec long, recv_ps long"


def v49(ptype, cid, trailer, tsi, tsf, payload, sec=5, frac=7, words=None):
    body = b""
    body += struct.pack(">I", 77) if ptype else b""
    body += bytes(range(8)) if cid else b""
    body += struct.pack(">I", sec) if tsi else b""
    body += struct.pack(">Q", frac) if tsf else b""
    body += payload + (b"\0\0\0\x09" if trailer else b"")
    n = 1 + len(body) // 4 if words is None else words
    return struct.pack(">I", ptype << 28 | cid << 27 | trailer << 26 | tsi << 22 | tsf << 20 | n) + body


def table(spark, pkts, channel="0"):
    return spark.createDataFrame([(channel, k, p, 100 + k, 0) for k, p in enumerate(pkts)], PACKETS)


def test_v49_all_layouts(spark):
    cases = list(itertools.product((0, 1, 4), (0, 1), (0, 1), (0, 1), (0, 2)))
    rows = P.parse_v49(table(spark, [v49(t, c, r if t != 4 else 0, i, f, b"\1\2\3\4" * 3) for t, c, r, i, f in cases])).orderBy("seq").collect()
    for (t, c, r, i, f), row in zip(cases, rows, strict=True):
        assert not row["_corrupt"]
        assert row["stream_id"] == (77 if t else None)
        assert (bytes(row["class_id"]) if row["class_id"] is not None else None) == (bytes(range(8)) if c else None)
        assert row["sec"] == (5 if i else None) and row["frac"] == (7 if f else None)
        assert row["trailer"] == (9 if r and t != 4 else None)
        assert bytes(row["payload"]) == (b"\1\2\3\4" * 3 if t != 4 else b"")


def test_v49_malformed(spark):
    rows = P.parse_v49(table(spark, [b"", b"\1\2\3", v49(1, 0, 0, 0, 0, b"\0" * 8, words=99), v49(1, 1, 0, 1, 1, b"")[:6], None, v49(1, 0, 1, 0, 0, b"\0" * 8, words=0)])).orderBy("seq").collect()
    assert [r["_corrupt"] for r in rows] == [True] * 6 and len(rows[2]["payload"]) == 8 and rows[5]["trailer"] is None


def test_sdds(spark):
    pkt = bytes(8) + struct.pack(">QI", 2**64 - 1, 2**32 - 1) + bytes(36) + bytes(1024)
    r = P.parse_sdds(table(spark, [pkt, pkt[:100]])).orderBy("seq").collect()
    # Seconds are cut to 32 bits, and the rest is taken modulo 2**64.
    sec = (2**64 - 1) // 4_000_000_000 % 2**32
    assert r[0]["ttag"] == 2**64 - 1 and r[0]["ttage"] == 2**32 - 1 and r[0]["sec"] == sec and r[0]["frac"] == ((2**64 - 1) * 250 - sec * 10**12) % 2**64
    assert framing.stov(table(spark, [pkt]), 256, "sdds").count() == 1
    assert [x["_corrupt"] for x in r] == [False, True]


def test_transport_and_slots_validate(spark):
    with pytest.raises(ValueError):
        P.parse(table(spark, []), "other")
    with pytest.raises(ValueError):
        P.slots(spark.createDataFrame([(b"",)], "data binary"), 0)
    rows = P.slots(spark.createDataFrame([(b"abcde",), (b"",), (None,)], "data binary"), 2).orderBy("slot").collect()
    assert [bytes(r["pkt"]) for r in rows] == [b"ab", b"cd", b"e"]
    held = P.block(table(spark, [b"abcdef", b"x"]), 4, 2).first()
    assert bytes(held["data"]) == b"abcdx\xff\xff\xff"


def test_integers(spark):
    raw = bytes.fromhex("80007FFFFFFF0000")
    df = spark.createDataFrame([(raw,), (b"",)], "p binary")
    assert [r[0] for r in df.select(C.native_int16(F.col("p"))).collect()] == [[-32768, 32767, -1, 0], []]
    assert df.select(C.native_int16(F.col("p"), False)).first()[0] == [128, -129, -1, 0]
    assert C.decode(raw, "cf32").tolist() == [-32768, 32767, -1, 0] and C.decode(raw, "f64", "u8").tolist() == [float(0x80007FFFFFFF0000)]
    for kind in C.TO_64:
        for swap in (True, False):
            assert C.decode(raw, "f64", kind, swap).tolist() == np.frombuffer(raw, (">" if swap else "<") + kind).astype(float).tolist()
    for bad in (("f32", "i8"), ("f16", "i2")):
        with pytest.raises(ValueError):
            C.decode(raw, *bad)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 65), st.booleans())
def test_fft_matches_sum(n, shifted):
    r = np.random.default_rng(n)
    x = r.standard_normal((2, n)) + 1j * r.standard_normal((2, n))
    k = np.arange(n)
    want = x @ np.exp(-2j * np.pi * np.outer(k, k) / n)
    if shifted:
        want = np.concatenate([want[:, n // 2 :], want[:, : n // 2]], 1)
    assert np.allclose(S.fft(x.real.copy(), x.imag.copy(), None, shifted), want)
    single = S.fft(x.real.astype("f4"), x.imag.astype("f4"), None, shifted)
    assert single.dtype == np.complex64 and np.allclose(single, want, rtol=1e-3, atol=1e-3)


def test_windows_and_psd(spark):
    assert S.window("hamming", 5)[0] == pytest.approx(0.08) and S.window("hamming", 5)[-1] == pytest.approx(0.08)
    assert S.window("blackman_harris", 4)[2] == pytest.approx(1.0)
    assert S.interleaved(np.array([1, 2])).tolist() == [1, 1, 2, 2]
    for bad in (("hamming", 1), ("none", 4), ("blackman_harris", 0)):
        with pytest.raises(ValueError):
            S.window(*bad)
    assert S.psd(np.array([[0, 1, 10**0.5]]) + 0j, 1, 1).round(9).tolist() == [[0, 0, 10]]
    assert S.shift(np.arange(5)).tolist() == [2, 3, 4, 0, 1] and S.shift(np.arange(4)).tolist() == [2, 3, 0, 1]
    assert np.allclose(S.rfft(np.arange(8.0)), np.fft.fft(np.arange(8.0))[:5])
    assert spark.sql("select 1").select(S.native_db(F.lit(float("nan")))).first()[0] != 0
    S.register(spark)
    assert spark.sql("select wl_shift(array(0D, 1D, 2D, 3D, 4D)) x").first()[0] == [2, 3, 4, 0, 1]
    assert spark.sql("select wl_fft(array(1D, 1D), array(0D, 0D)) x").first()[0]["re"] == [2, 0]


def packets_of(sizes, seed=0):
    r = np.random.default_rng(seed)
    data = [r.integers(-32768, 32768, (n, 2)) for n in sizes]
    return data, [v49(1, 0, 0, 1, 1, d.astype(">i2").tobytes(), sec=k, frac=k) for k, d in enumerate(data)]


@pytest.mark.parametrize("size,sizes", [(4, [3, 0, 9, 1, 4, 2]), (5, [5, 5]), (1, [2]), (8, [1, 2, 3])])
def test_frames_span_packets(spark, size, sizes):
    data, pkts = packets_of(sizes)
    flat, owner = np.concatenate(data), np.repeat(np.arange(len(sizes)), sizes)
    want = [(k, owner[k * size], flat[k * size : (k + 1) * size, 0].tolist(), flat[k * size : (k + 1) * size, 1].tolist()) for k in range(len(flat) // size)]
    got = framing.stov(table(spark, pkts), size).orderBy("frame").collect()
    assert [(r["frame"], r["ts"]["sec"], r["re"], r["im"]) for r in got] == want
    for step in (1, 2, len(data)):
        framer, out = stateful.Framer(size, 4), []
        for k in range(0, len(data), step):
            part = range(k, min(len(data), k + step))
            out += framer.push([data[i].astype(">i2").tobytes() for i in part], list(part), list(part))
        assert [(f, s, *(C.decode(b, "cf64")[i::2].tolist() for i in (0, 1))) for f, s, _, b in out] == want


def test_no_packet_is_lost(spark):
    """A seq that repeats, equal packets, no channel, no seq: every sample stands in a frame."""
    data, pkts = packets_of([4, 4, 4, 4])
    rows = [("0", s, p, 0, 0) for s, p in zip((0, 1, 1, 2), pkts, strict=True)] + [(None, s, p, 0, 0) for s, p in zip((None, 5, 5, 6), [pkts[0], pkts[1], pkts[1], pkts[2]], strict=True)]
    df = spark.createDataFrame(rows, PACKETS)
    got = {(r["channel"], r["frame"]): r["re"] for r in framing.stov(df, 4).collect()}
    assert [got["0", k] for k in range(4)] == [d[:, 0].tolist() for d in data]
    assert [got[None, k] for k in range(4)] == [data[k][:, 0].tolist() for k in (0, 1, 1, 2)]
    for size in (3, 7, 16):
        assert framing.stov(df, size).count() == 2 * (16 // size)
    assert sum(len(r["data"]) for r in sinks.file_bytes(df.where("channel is not null"), 1000).collect()) == 64
    assert sum(len(r["data"]) for r in sinks.file_bytes(df.where("channel is null"), 50).collect()) == 50


def test_real_frames_and_checks(spark):
    data, pkts = packets_of([3, 3])
    got = framing.stov(table(spark, pkts), 4, dtype="f32").orderBy("frame").collect()
    assert sum((r["x"] for r in got), []) == np.concatenate(data).ravel().tolist()
    with pytest.raises(ValueError):
        framing.stov(table(spark, pkts), 0)
    assert framing.stov(table(spark, []), 4).count() == 0
    with pytest.raises(Exception, match="fft_size"):
        spectral.fft(framing.stov(table(spark, pkts), 3), 4).collect()
    with pytest.raises(ValueError):
        spectral.psd(framing.stov(table(spark, pkts), 3), 3)


@pytest.mark.parametrize("chunk,run", [(1, 2), (3, 1), (100, 256), (2, 2)])
def test_smoothing_by_chunks(spark, chunk, run):
    x = np.random.default_rng(1).standard_normal((10, 4))
    df = spark.createDataFrame([("a", k, (k, 0), v.tolist()) for k, v in enumerate(x)], "channel string, frame long, ts struct<sec:bigint,ps:bigint>, psd array<double>")
    got = smoothing.exp_smooth(df, 0.3, chunk=chunk, run=run).orderBy("frame").collect()
    assert [r["frame"] for r in got] == list(range(9)) and got[3]["ts"]["sec"] == 3
    assert np.allclose([r["psd"] for r in got], smoothing.smoothed(x, 0.3, None)[:-1])
    assert smoothing.exp_smooth(df, 1.0).count() == 10
    none = df.withColumn("channel", F.lit(None).cast("string"))
    assert smoothing.exp_smooth(df.unionByName(none), 0.3, chunk=chunk, run=run).count() == 18


def test_histogram(spark):
    rows = [("0", b, b, 0, v) for b, v in enumerate([[0, 5000], [-5000], [1, 2, 3], [0], [0, 0]])]
    df = spark.createDataFrame(rows, "channel string, block_seq long, recv_sec long, recv_ps long, i array<int>")
    got = histogram.histogram(df, 3, 2).orderBy("win").collect()
    assert [r["ts"]["sec"] for r in got] == [1, 2] + ([4] if len(got) > 2 else [])
    assert got[0]["counts"] == [1, 0, 0, 0, 1, 0, 0, 1] and got[1]["counts"] == [0, 0, 0, 0, 0, 1, 1, 1]
    _, pkts = packets_of([4, 4, 4])
    assert histogram.from_packets(table(spark, pkts), 40, 2, 4, 7).count() == 1
    none = df.withColumn("channel", F.lit(None).cast("string"))
    assert sorted(tuple(r[1:]) for r in histogram.histogram(none, 3, 2).collect()) == sorted(tuple(r[1:]) for r in got)


@pytest.mark.parametrize("limit", [0, 1, 12, 13, 1000])
def test_byte_limits(spark, tmp_path, limit):
    data, pkts = packets_of([3, 1, 5])
    raw = np.concatenate(data).astype(">i2").tobytes()
    rows = sinks.file_bytes(table(spark, [*pkts, v49(4, 0, 0, 0, 0, b"\0" * 4)]), limit)
    out = str(tmp_path / "out")
    sinks.write_raw(rows, out)
    assert sinks.read_raw(out) == raw[:limit]
    # Written anew it holds the new bytes alone, however either write was parted.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    sinks.write_raw(sinks.file_bytes(table(spark, pkts * 9), 300), "file://" + out)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sinks.read_raw(out) == (raw * 9)[:300]
    sinks.write_raw(rows, out)
    assert sinks.read_raw(out) == raw[:limit] and len(list(tmp_path.glob("out/*.dat"))) == len(sinks.manifest(out)["parts"])
    frames = framing.stov(table(spark, pkts), 4, dtype="cf32")
    got = b"".join(bytes(r["data"]) for r in sinks.frame_bytes(frames, limit).orderBy("frame").collect())
    assert got == np.concatenate(data)[:8].astype("<f4").tobytes()[:limit]


def test_streams_equal_batch(spark, tmp_path):
    data, pkts = packets_of([3, 7, 2, 9, 4, 1])
    df, path = table(spark, pkts), str(tmp_path / "p")
    for k in range(3):
        df.where(F.expr(f"seq div 2 = {k}")).coalesce(1).write.mode("append").parquet(path)
    got = stateful.run_to_end(stateful.stov(spark.readStream.schema(df.schema).parquet(path), 4), "t_stov").orderBy("frame").collect()
    want = framing.stov(df, 4).orderBy("frame").collect()
    assert [(r["frame"], r["ts"], r["re"], r["im"]) for r in got] == [(r["frame"], r["ts"], r["re"], r["im"]) for r in want]


def test_graph(spark):
    _, pkts = packets_of([40] * 4)
    g = Graph(PSD_GRAPH)
    assert g.nodes["psd"].properties["fft_size"] == 32 and g.nodes["fft"].properties["window"] == "blackman_harris"
    got = g.build(spark, "psd", table(spark, pkts)).count()
    assert got == 5
    link = lambda a, b: {"output": {"component": a, "port": "data_out"}, "input": {"component": b, "port": "data_in"}}
    part = lambda *c: [{"name": x} for x in c]
    bad = [
        {"components": part("nothing")},
        {"components": part("stov", "fft"), "connections": [{"output": {"component": "stov", "port": "out"}, "input": {"component": "fft", "port": "data_in"}}]},
        {"components": part("replay_source", "fft"), "connections": [link("replay_source", "fft")]},
        {"components": part("stov", "psd") , "connections": [link("psd", "stov")]},
        {"components": [{"name": "a", "component": "fft"}, {"name": "b", "component": "fft"}], "connections": [link("a", "b"), link("b", "a")]},
        {"components": [{"name": "fft", "create_arg": "i8"}]},
        {"components": [{"name": "fft", "properties": [{"name": "speed", "value": 1}]}]},
    ]
    for spec in bad:
        with pytest.raises(GraphError):
            Graph(spec)
    assert {"udp_source", "stov", "fft", "psd", "exp_smooth", "histogram", "file_writer", "aligned_mem_writer"} <= set(REGISTRY)
    writer = Graph({"components": [{"name": "replay_source"}, {"name": "file_writer", "properties": [{"name": "num_bytes", "value": 10}]}], "connections": [link("replay_source", "file_writer")]})
    assert sum(len(r["data"]) for r in writer.build(spark, source=table(spark, pkts)).collect()) == 10


def send(pkts, port, stop):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        while not stop.is_set():
            for p in pkts:
                s.sendto(p, ("127.0.0.1", port))
                time.sleep(0.002)


def free_port():
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def link(*names):
    return [{"output": {"component": a, "port": "data_out"}, "input": {"component": b, "port": "data_in"}} for a, b in itertools.pairwise(names)]


def prop(**values):
    return [{"name": k, "value": v} for k, v in values.items()]


@pytest.fixture
def feed():
    """Datagrams sent again and again to a port, each payload the same samples."""
    stop, port = threading.Event(), free_port()
    data = np.arange(64).reshape(32, 2)
    pkts = [v49(1, 0, 0, 1, 1, data.astype(">i2").tobytes(), sec=k) for k in range(20)]
    sender = threading.Thread(target=send, args=(pkts, port, stop), daemon=True)
    yield port, data, sender.start
    stop.set()


def test_capture_from_a_socket_ends_at_its_limit(spark, tmp_path, feed):
    """The topology of a raw capture, from datagrams to a file of so many bytes."""
    port, data, start = feed
    out = str(tmp_path / "capture")
    g = Graph({"components": [{"name": "udp_source", "properties": prop(ip_addr="127.0.0.1", port=port, msg_size=200, num_msgs=16)}, {"name": "file_writer", "properties": prop(filename=out, num_bytes=1000)}], "connections": link("udp_source", "file_writer")})
    query = g.run(spark)
    start()
    assert query.awaitTermination(90)
    raw = data.astype(">i2").tobytes()
    assert sinks.read_raw(out) == (raw * 9)[:1000]
    # A run that takes its checkpoint up again finds the capture full.
    capture = sinks.Capture(lambda rows: rows, out, 1000)
    capture.add(table(spark, []).selectExpr("channel", "seq", "pkt as data"), 99)
    assert capture.full.is_set() and capture.total() == 1000


def test_spectra_from_a_socket(spark, feed):
    """The topology of a power-spectrum graph in single precision, from datagrams."""
    port, data, start = feed
    shared = prop(window="BLACKMAN_HARRIS", fft_size=32, msg_size=200)
    parts = [("udp_source", "", prop(ip_addr="127.0.0.1", port=port, num_msgs=16)), ("stov", "cf32", prop(output_size=32, transport="vita49")), ("fft", "f32", prop(fftw_threads=2)), ("psd", "f32", prop(sample_rate=24576000)), ("exp_smooth", "f32", prop(alpha=0.5))]
    g = Graph({"properties": shared, "components": [{"name": n, "properties": p} | ({"create_arg": t} if t else {}) for n, t, p in parts], "connections": link(*(p[0] for p in parts))})
    with pytest.raises(GraphError, match="both hold state"):
        g.run(spark, "exp_smooth")
    rows = g.run(spark, "psd")
    assert rows.isStreaming and dict(rows.dtypes)["psd"] == "array<float>"
    seen: list = []
    query = rows.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).start()
    start()
    until = time.monotonic() + 90
    while not seen and time.monotonic() < until:
        time.sleep(0.2)
    query.stop()
    taper = S.window("blackman_harris", 32, np.float32)
    x = data.astype("f4")
    want = S.psd(S.fft(x[:, 0].copy(), x[:, 1].copy(), taper), 24576000, S.power_sum(taper))
    assert seen and all(np.allclose(r["psd"], want, atol=1e-2) for r in seen)
    assert {r["ts"]["ps"] for r in seen} == {7} and all(0 <= r["ts"]["sec"] < 20 for r in seen)


def test_stream_smoothing_keeps_times_and_type(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((7, 3)).astype("f4")
    df = spark.createDataFrame([("a", k, (10 + k, k), v.tolist()) for k, v in enumerate(x)], "channel string, frame long, ts struct<sec:bigint,ps:bigint>, x array<float>")
    path = str(tmp_path / "f")
    for k in range(3):
        df.where(F.expr(f"frame div 3 = {k}")).coalesce(1).write.mode("append").parquet(path)
    rows = stateful.exp_smooth(spark.readStream.schema(df.schema).parquet(path), 0.25, "x", "f32")
    assert dict(rows.dtypes)["x"] == "array<float>"
    got = stateful.run_to_end(rows, "t_smooth").orderBy("frame").collect()
    assert [(r["frame"], r["ts"]["sec"], r["ts"]["ps"]) for r in got] == [(k, 10 + k, k) for k in range(6)]
    assert np.allclose([r["x"] for r in got], smoothing.smoothed(x, 0.25, None)[:-1], atol=1e-6)


def test_stream_histogram_equals_batch(spark, tmp_path):
    data, pkts = packets_of([4] * 13, seed=2)
    df, path = table(spark, [*pkts[:5], v49(4, 0, 0, 0, 0, b""), *pkts[5:]]), str(tmp_path / "p")
    for k in range(3):
        df.where(F.expr(f"seq div 5 = {k}")).coalesce(1).write.mode("append").parquet(path)
    options = prop(msg_size=40, num_msgs=3, adc_bits=4, sample_rate=7, transport="vita49")
    g = Graph({"components": [{"name": "replay_source", "properties": prop(path=path, streaming=True)}, {"name": "histogram", "properties": options}], "connections": link("replay_source", "histogram")})
    want = sorted(map(tuple, g.build(spark, "histogram", df).collect()))
    got = sorted(map(tuple, stateful.run_to_end(g.run(spark, "histogram"), "t_hist").collect()))
    # The last block has two of its three packets: it may still grow.
    assert len(want) == 5 and got == want[:4]


def test_accessors_and_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(S.native_at(F.col("x"), 1)).collect()] == [2.0, None]
    assert df.select(S.native_bytes(F.col("x"), True)).first()[0] == 8
    for pos in (-1, 2):
        with pytest.raises(Exception, match="outside"):
            df.select(S.native_at(F.col("x"), pos)).collect()
    S.register(spark)
    assert spark.sql("select wl_ema(array(0D), array(4D), 0.25D) x").first()[0] == [1.0]
    assert spark.sql("select wl_window_sum('HAMMING', 8) x").first()[0] == pytest.approx(S.power_sum(S.window("hamming", 8)))
    assert spark.sql("select wl_rfft(array(1D, 0D, 0D, 0D)) x").first()[0]["re"] == [1, 1, 1]
    assert spark.sql("select wl_psd(array(1D, 1D), array(0D, 0D), 1D, '') x").first()[0] == pytest.approx([10 * np.log10(2), 0])
    assert spark.sql("select wl_apply(array(1D, 1D), 'hamming') x").first()[0] == pytest.approx([0.08, 0.08])
    frames = spark.createDataFrame([("0", 0, (1, 0), [1.0, 2.0], [0.0, 0.0]), ("0", 1, (1, 0), [], []), ("0", 2, (1, 0), None, None)], "channel string, frame long, ts struct<sec:bigint,ps:bigint>, re array<double>, im array<double>")
    assert spectral.fft(frames, 2).count() == 1
    assert spectral.window_sum("hamming", 64, "f32", rounded=True) != spectral.window_sum("hamming", 64, "f32")


def test_udp_receiver():
    assert udp.is_multicast("239.1.2.3") and not udp.is_multicast("10.0.0.1") and not udp.is_multicast("")
    assert udp.interface_ip("lo") in ("127.0.0.1", "") and udp.interface_ip("nothing0") == ""
    with pytest.raises(ValueError):
        udp.Receiver(msg_size=0, num_msgs=1)
    r = udp.Receiver(ip_addr="127.0.0.1", msg_size=4, num_msgs=2)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for m in (b"abcdef", b"x", b"yz"):
            s.sendto(m, r.socket.getsockname())
    assert r.receive(0) == 2 and [r.held[k][2] for k in (0, 1)] == [b"abcd", b"x"]
    assert r.receive(2) == 3 and 0 <= r.held[2][4] < 10**12
    assert r.receive(3, 0.01) == 3
