"""The stream operators as queries over the driver's tables, with the same in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import packets as P
from .functions import spectral as S
from .functions.convert import TO_64, decode, native_int16
from .operators import framing, histogram, sinks, smoothing, spectral
from .plans.graph import Graph
from .shared import fresh_path
from .sources import replay as R
from .streaming import stateful

N, FRAME, RATE = 64, 96, 1000.0
BINS, BLOCK, FLUSH = 8, 64, 1000
ALPHA, LIMIT = 0.25, 20_000
PACKET_BLOCK, PACKET_FLUSH = 2, 700


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def long_form(df: DataFrame, value: str, out: str, digits: int = 6) -> DataFrame:
    return df.select("frame", F.posexplode(value).alias("bin", "v")).select("frame", F.col("bin").cast("long").alias("bin"), rounded("v", digits).alias(out))


def complex_form(df: DataFrame) -> DataFrame:
    rows = df.select("frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "v"))
    return rows.select("frame", F.col("bin").cast("long").alias("bin"), rounded("v.re").alias("re"), rounded("v.im").alias("im"))


def window_blackman_harris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(S.native_window("blackman_harris", N)).alias("n", "v")).select(F.col("n").cast("long").alias("n"), rounded("v", 9).alias("w"))


def window_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(S.native_window("hamming", N)).alias("n", "v")).select(F.col("n").cast("long").alias("n"), rounded("v", 9).alias("w"))


def window_power_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(S.native_window("blackman_harris", N), F.lit(0.0), lambda a, w: a + w * w)
    return spark.range(1).select(rounded(total, 9).alias("w_sum"))


def samples_int16_to_f64(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.parse(R.v49_packets(spark, sf_dir), "vita49").select("seq", F.posexplode(native_int16(F.col("payload"))).alias("k", "v"))
    return rows.groupBy("seq", F.expr("cast(k div 2 as long)").alias("k")).agg(F.max(F.when(F.col("k") % 2 == 0, F.col("v"))).cast("double").alias("i"), F.max(F.when(F.col("k") % 2 == 1, F.col("v"))).cast("double").alias("q"))


def v49_parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.parse_v49(R.v49_packets(spark, sf_dir))
    return rows.select("seq", F.col("header.ptype").cast("long").alias("ptype"), "stream_id", F.coalesce(F.hex("class_id"), F.lit("")).alias("class_id"), "sec", F.col("frac").cast("long").alias("frac"), F.coalesce("trailer", F.lit(-1)).alias("trailer"), F.length("payload").cast("long").alias("n_bytes"), "_corrupt")


def sdds_parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.parse_sdds(R.sdds_packets(spark, sf_dir))
    return rows.select("seq", F.col("ttag").cast("long").alias("ttag"), "ttage", "sec", F.col("frac").cast("long").alias("ps"), F.length("payload").cast("long").alias("n_bytes"))


def integer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second number of each payload read as every kind of integer, in both byte orders."""

    def run(batches):
        for b in batches:
            for seq, payload in zip(b.column("seq").to_pylist(), b.column("payload").to_pylist(), strict=True):
                rows = [(seq, kind, swap, float(decode(payload, "f64", kind, swap)[1])) for kind in TO_64 for swap in (True, False)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["seq", "kind", "byteswap", "v"])

    return P.parse(R.v49_packets(spark, sf_dir), "vita49").where("length(payload) >= 16").select("seq", "payload").mapInArrow(run, "seq long, kind string, byteswap boolean, v double")


def v49_filter_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse(R.v49_packets(spark, sf_dir), "vita49").select("seq", F.col("header.ptype").cast("long").alias("ptype"))


def v49_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_v49(R.v49_packets(spark, sf_dir)).where(P.is_context(F.col("header"))).select("seq", F.length("payload").cast("long").alias("n_bytes"))


def packet_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = P.block(R.v49_packets(spark, sf_dir), 1060, 8)
    return P.slots(blocks, 1060).select("block_seq", F.col("slot").cast("long").alias("slot"), F.length("pkt").cast("long").alias("n_bytes"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.stov(R.v49_packets(spark, sf_dir), FRAME)


def stov_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complex_form(_frames(spark, sf_dir))


def stov_frame_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame", F.col("ts.sec").alias("sec"), F.col("ts.ps").alias("ps"))


def stov_repeated_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets two by two of one seq, on a channel without a name: none is lost."""
    packets = R.v49_packets(spark, sf_dir).withColumn("seq", F.expr("seq div 2")).withColumn("channel", F.lit(None).cast("string"))
    return complex_form(framing.stov(packets, FRAME))


def stov_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of single-precision numbers I, Q, I, Q ..."""
    return framing.stov(R.v49_packets(spark, sf_dir), FRAME, dtype="f32").select("frame", F.posexplode("x").alias("bin", "v")).select("frame", F.col("bin").cast("long").alias("bin"), F.col("v").cast("double").alias("v"))


def sdds_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complex_form(framing.stov(R.sdds_packets(spark, sf_dir), FRAME, "sdds", "cf32"))


def frame_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.real_frames(spark, sf_dir)
    return rows.select("frame", rounded(S.native_at(F.col("psd"), 3)).alias("third"), F.size("psd").cast("long").alias("n"), S.native_bytes(F.col("psd")).alias("n_bytes"))


def rfft_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complex_form(spectral.rfft(R.real_frames(spark, sf_dir).withColumnRenamed("psd", "x"), 64, "hamming"))


def window_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, k, float(v)) for name in S.WINDOWS for k, v in enumerate(S.window(name.upper(), N, np.float32))]
    return spark.createDataFrame(rows, "name string, n long, w double").withColumn("w", rounded("w"))


def fft_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complex_form(spectral.fft(R.complex_frames(spark, sf_dir), 32, shift=False))


def fft_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complex_form(spectral.fft(R.complex_frames(spark, sf_dir), 32, "hamming"))


def fft_shift_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(S.native_shift(F.array(*map(F.lit, range(5))))).alias("pos", "v")).select(F.col("pos").cast("long").alias("pos"), F.col("v").cast("long").alias("v"))


def psd_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(spectral.spectra_db(R.complex_frames(spark, sf_dir), 32, "blackman_harris", RATE), "psd", "db", 4)


def psd_zero_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.transform(F.array(F.lit(0.0), F.lit(1.0), F.lit(10.0)), S.native_db)).alias("bin", "v")).select(F.col("bin").cast("long").alias("bin"), rounded("v").alias("db"))


def exp_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(smoothing.exp_smooth(R.real_frames(spark, sf_dir), ALPHA, chunk=64), "psd", "v")


def exp_smooth_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(smoothing.exp_smooth(R.real_frames(spark, sf_dir), 1.0), "psd", "v")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = R.iq_samples(spark, sf_dir).groupBy(F.expr(f"pos div {BLOCK}").alias("block_seq")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "i"))), lambda x: x["i"]).alias("i"))
    return held.select(F.lit("0").alias("channel"), "block_seq", F.col("block_seq").alias("recv_sec"), F.lit(0).cast("long").alias("recv_ps"), "i")


def histogram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = 1 << BINS
    counts = R.iq_samples(spark, sf_dir).groupBy(histogram.bin_of(F.col("i"), BINS).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(size).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_flush_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = histogram.histogram(_blocks(spark, sf_dir), BINS, FLUSH)
    return rows.select("win", F.col("ts.sec").alias("sec"), F.posexplode("counts").alias("bin", "n")).select("win", "sec", F.col("bin").cast("long").alias("bin"), "n")


def histogram_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = histogram.from_packets(R.v49_packets(spark, sf_dir), 1060, PACKET_BLOCK, BINS, PACKET_FLUSH)
    return rows.select("win", F.col("ts.sec").alias("sec"), F.posexplode("counts").alias("bin", "n")).select("win", "sec", F.col("bin").cast("long").alias("bin"), "n")


def byte_limited_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.file_bytes(R.v49_packets(spark, sf_dir), LIMIT).select("seq", F.col("at").alias("byte_at"), F.length("data").cast("long").alias("n_bytes"), F.md5(F.hex("data").cast("binary")).alias("digest"))


def frame_limited_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    def numbers(batches):
        for b in batches:
            sums = [float(np.frombuffer(x, "<f8", len(x) // 8).sum()) for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([len(x) for x in b.column("data").to_pylist()], pa.int64()), pa.array(sums)], ["frame", "byte_at", "n_bytes", "total"])

    rows = sinks.frame_bytes(R.complex_frames(spark, sf_dir), LIMIT).select("frame", F.col("at").alias("byte_at"), "data")
    return rows.mapInArrow(numbers, "frame long, byte_at long, n_bytes long, total double").withColumn("total", rounded("total"))


#: The topology of a power-spectrum graph, with properties shared by name.
PSD_GRAPH = {
    "name": "psd",
    "properties": [{"type": "string", "name": "window", "value": "blackman_harris"}, {"type": "uint64", "name": "fft_size", "value": 32}],
    "components": [
        {"name": "replay_source"},
        {"name": "stov", "create_arg": "cf64", "properties": [{"name": "output_size", "value": 32}, {"name": "transport", "value": "vita49"}]},
        {"name": "fft", "create_arg": "f64"},
        {"name": "psd", "create_arg": "f64", "properties": [{"name": "sample_rate", "value": RATE}]},
    ],
    "connections": [{"output": {"component": a, "port": "data_out"}, "input": {"component": b, "port": "data_in"}} for a, b in (("replay_source", "stov"), ("stov", "fft"), ("fft", "psd"))],
}


def graph_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(Graph(PSD_GRAPH).build(spark, "psd", R.v49_packets(spark, sf_dir)), "psd", "db", 4)


def _replayed(df: DataFrame, order: str) -> DataFrame:
    """A stream of df's rows, in three files."""
    path = fresh_path(df.sparkSession, "replay")
    for k in range(3):
        df.where(F.pmod(F.expr(f"{order} div 8"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def stream_stov(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stateful.stov(_replayed(R.v49_packets(spark, sf_dir), "seq"), FRAME)
    return complex_form(stateful.run_to_end(rows, "stov"))


def stream_exp_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stateful.exp_smooth(_replayed(R.real_frames(spark, sf_dir), "frame"), ALPHA)
    return long_form(stateful.run_to_end(rows, "smooth"), "psd", "v")


def _counts(rows: DataFrame) -> DataFrame:
    return rows.select("win", F.col("ts.sec").alias("sec"), F.posexplode("counts").alias("bin", "n")).select("win", "sec", F.col("bin").cast("long").alias("bin"), "n")


def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stateful.histogram_blocks(_replayed(_blocks(spark, sf_dir), "block_seq"), BINS, FLUSH)
    return _counts(stateful.run_to_end(rows, "histogram"))


def stream_histogram_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stateful.histogram(_replayed(R.v49_packets(spark, sf_dir), "seq"), 1060, PACKET_BLOCK, BINS, PACKET_FLUSH)
    return _counts(stateful.run_to_end(rows, "histogram"))


QUERIES = {f.__name__: f for f in (window_blackman_harris, window_hamming, window_power_sum, samples_int16_to_f64, v49_parse_fields, sdds_parse_time, integer_kinds, v49_filter_data, v49_context, packet_slots, stov_frames, stov_frame_timestamps, stov_repeated_seq, stov_single, sdds_frames, frame_accessors, window_single, rfft_spectrum, fft_spectrum, fft_shifted, fft_shift_odd, psd_db, psd_zero_power, exp_smooth, exp_smooth_passthrough, histogram_counts, histogram_flush_windows, histogram_packets, byte_limited_sink, frame_limited_sink, graph_psd, stream_stov, stream_exp_smooth, stream_histogram, stream_histogram_packets)}

_BH = "(0.35875 - 0.48829 * cos(2 * pi() * {k} / {n}) + 0.14128 * cos(4 * pi() * {k} / {n}) - 0.01168 * cos(6 * pi() * {k} / {n}))"
_HAM = "(0.54 - 0.46 * cos(2 * pi() * {k} / ({n} - 1)))"
_V = "v as (select event_id as pos, event_id // 256 as pkt, cast(floor(value) as int) - 245 as i, cast(user_id % 1000 as int) as q from events)"
_K = f"{_V}, k as (select pkt, count(*) as n from v group by pkt)"
_D = f"{_V}, d as (select i, q, pkt, row_number() over (order by pos) - 1 as p from v where pkt % 5 <> 4)"
_FR = f"{_D}, f as (select p // {FRAME} as frame, p % {FRAME} as bin, i, q, pkt from d), g as (select frame from f group by frame having count(*) = {FRAME})"


def _dft(source: str, taper: str) -> str:
    return f"""e as ({source}),
x as (select frame, k, sum(w * (re * cos(2 * pi() * k * n / 32) + im * sin(2 * pi() * k * n / 32))) as re, sum(w * (im * cos(2 * pi() * k * n / 32) - re * sin(2 * pi() * k * n / 32))) as im
  from (select frame, n, re, im, {taper} as w from e), range(32) t(k) group by frame, k)"""


_E = "select vec_id as frame, n, embedding[2 * n + 1]::double as re, embedding[2 * n + 2]::double as im from embeddings, range(32) t(n)"
_DB = f"select frame, (k + 16) % 32 as bin, round(10 / log2(10) * log2((re * re + im * im) / {RATE} / (select sum({_BH.format(k='n', n=32)} ** 2) from range(32) t(n))), 4) + 0.0 as db from x"
_SMOOTH = f"""with recursive x as (select vec_id as frame, bin, embedding[bin + 1]::double as v from embeddings, range(64) t(bin)),
s as (select frame, bin, v from x where frame = 0 union all select x.frame, x.bin, {ALPHA} * x.v + {1 - ALPHA} * s.v from s join x on x.frame = s.frame + 1 and x.bin = s.bin)
select frame, bin, round(v, 6) + 0.0 as v from s where frame < (select max(vec_id) from embeddings)"""
_FLUSH = f"""with recursive {_V}, b as (select pos // {BLOCK} as b, count(*) as n from v group by 1),
w as (select b, 0::bigint as win, n as total from b where b = 0
  union all select b.b, case when w.total > {FLUSH} then w.win + 1 else w.win end, case when w.total > {FLUSH} then b.n else w.total + b.n end from w join b on b.b = w.b + 1),
c as (select win, max(b) as sec from w group by win having max(total) > {FLUSH}),
h as (select win, greatest(0, least(255, i + 128)) as bin, count(*) as n from v join w on w.b = v.pos // {BLOCK} group by 1, 2)
select c.win, c.sec, t.bin::bigint as bin, coalesce(h.n, 0)::bigint as n from c cross join range(256) t(bin) left join h on h.win = c.win and h.bin = t.bin"""
_STOV = f"with {_FR} select frame, bin, i::double as re, q::double as im from f join g using (frame)"
_PACKET_FLUSH = f"""with recursive {_V}, b as (select pkt // {PACKET_BLOCK} as b, min(pkt) + 1704067200 as sec, count(*) filter (pkt % 5 <> 4) as n from v group by 1),
w as (select b, 0::bigint as win, n as total from b where b = 0
  union all select b.b, case when w.total > {PACKET_FLUSH} then w.win + 1 else w.win end, case when w.total > {PACKET_FLUSH} then b.n else w.total + b.n end from w join b on b.b = w.b + 1),
c as (select win, max(b.sec) as sec from w join b using (b) group by win having max(total) > {PACKET_FLUSH}),
h as (select win, greatest(0, least(255, i + 128)) as bin, count(*) as n from v join w on w.b = v.pkt // {PACKET_BLOCK} where pkt % 5 <> 4 group by 1, 2)
select c.win, c.sec, t.bin::bigint as bin, coalesce(h.n, 0)::bigint as n from c cross join range(256) t(bin) left join h on h.win = c.win and h.bin = t.bin"""
_SWAP = "(({x} & 255) * 256 + ({x} >> 8))"
_KINDS = f"""with {_V}, u as (select pkt, pos % 256 as k, i & 65535 as i, q & 65535 as q from v where pkt % 5 <> 4),
x as (select pkt, k, q as b2, {_SWAP.format(x="q")} as l2, i::hugeint * 65536 + q as b4, {_SWAP.format(x="q")}::hugeint * 65536 + {_SWAP.format(x="i")} as l4 from u where k < 4),
p as (select pkt, max(b2) filter (k = 0)::hugeint as b2, max(l2) filter (k = 0)::hugeint as l2, max(b4) filter (k = 1) as b4, max(l4) filter (k = 1) as l4,
  max(b4) filter (k = 2) * 4294967296 + max(b4) filter (k = 3) as b8, max(l4) filter (k = 3) * 4294967296 + max(l4) filter (k = 2) as l8 from x group by pkt having count(*) = 4),
y as ({" union all ".join(f"select pkt, '{n}' as n, {swap} as byteswap, {size} as bits, {c} as v from p" for n, size in (("2", 16), ("4", 32), ("8", 64)) for c, swap in ((f"b{n}", "true"), (f"l{n}", "false")))})
select pkt as seq, 'u' || n as kind, byteswap, v::ubigint::double as v from y union all select pkt, 'i' || n, byteswap, (case when v >= (2::hugeint ** (bits - 1))::hugeint then v - (2::hugeint ** bits)::hugeint else v end)::bigint::double from y"""
_SINGLE = "({a}::float::double - {b}::float::double * cos(2 * pi() * n / 63))::float"


def _bh_single() -> str:
    terms = " ".join(f"{sign} {a}::float::double * cos({2 * j} * pi() * n / {N})" for j, (sign, a) in enumerate(zip("+-+-", S.BLACKMAN_HARRIS, strict=True)))
    return f"({terms})::float"


ORACLES = {
    "window_blackman_harris": f"select n, round({_BH.format(k='n', n=N)}, 9) + 0.0 as w from range({N}) t(n)",
    "window_hamming": f"select n, round({_HAM.format(k='n', n=N)}, 9) + 0.0 as w from range({N}) t(n)",
    "window_power_sum": f"select round(sum({_BH.format(k='n', n=N)} ** 2), 9) + 0.0 as w_sum from range({N}) t(n)",
    "samples_int16_to_f64": f"with {_V} select pkt as seq, pos % 256 as k, i::double as i, q::double as q from v where pkt % 5 <> 4",
    "v49_parse_fields": f"""with {_K} select pkt as seq, case when pkt % 5 = 4 then 4 else 1 end::bigint as ptype, 77::bigint as stream_id, case when pkt % 3 = 0 then '0012345600010002' else '' end as class_id,
  1704067200 + pkt as sec, pkt * 1000000 as frac, case when pkt % 2 = 1 and pkt % 5 <> 4 then 0 else -1 end::bigint as trailer, case when pkt % 5 = 4 then 0 else 4 * n end::bigint as n_bytes, false as _corrupt from k""",
    "sdds_parse_time": f"with {_K} select pkt as seq, t as ttag, pkt * 7 as ttage, t // 4000000000 as sec, (t % 4000000000) * 250 as ps, 1024::bigint as n_bytes from (select pkt, pkt * {R.SDDS_STEP} + {R.SDDS_FIRST} as t from k)",
    "integer_kinds": _KINDS,
    "v49_filter_data": f"with {_K} select pkt as seq, 1::bigint as ptype from k where pkt % 5 <> 4",
    "v49_context": f"with {_K} select pkt as seq, 0::bigint as n_bytes from k where pkt % 5 = 4",
    "packet_slots": f"with {_K} select pkt // 8 as block_seq, pkt % 8 as slot, 1060::bigint as n_bytes from k",
    "stov_frames": _STOV,
    "stov_frame_timestamps": f"with {_FR} select frame, 1704067200 + pkt as sec, pkt * 1000000 as ps from f join g using (frame) where bin = 0",
    "stov_repeated_seq": _STOV,
    "stov_single": f"with {_D}, x as (select 2 * p as k, i as v from d union all select 2 * p + 1, q from d) select k // {FRAME} as frame, k % {FRAME} as bin, v::double as v from x where k // {FRAME} < (select count(*) // {FRAME} from x)",
    "sdds_frames": f"with {_K}, n as (select 256 * count(*) as n from k) select range // {FRAME} as frame, range % {FRAME} as bin, coalesce(i, 0)::double as re, coalesce(q, 0)::double as im from range((select n // {FRAME} * {FRAME} from n)) left join v on pos = range",
    "frame_accessors": "select vec_id as frame, round(embedding[4]::double, 6) + 0.0 as third, len(embedding)::bigint as n, 8 * len(embedding)::bigint as n_bytes from embeddings",
    "rfft_spectrum": f"""select vec_id as frame, k as bin, round(sum(w * v * cos(2 * pi() * k * n / 64)), 6) + 0.0 as re, round(-sum(w * v * sin(2 * pi() * k * n / 64)), 6) + 0.0 as im
  from (select vec_id, n, embedding[n + 1]::double as v, {_HAM.format(k="n", n=64)} as w from embeddings, range(64) t(n)), range(33) s(k) group by vec_id, k""",
    "window_single": f"select 'blackman_harris' as name, n, round({_bh_single()}::double, 6) + 0.0 as w from range({N}) t(n) union all select 'hamming', n, round({_SINGLE.format(a=0.54, b=0.46)}::double, 6) + 0.0 from range({N}) t(n)",
    "fft_spectrum": f"with {_dft(_E, '1.0')} select frame, k as bin, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im from x",
    "fft_shifted": f"with {_dft(_E, _HAM.format(k='n', n=32))} select frame, (k + 16) % 32 as bin, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im from x",
    "fft_shift_odd": "select range as pos, (range + 2) % 5 as v from range(5)",
    "psd_db": f"with {_dft(_E, _BH.format(k='n', n=32))} {_DB}",
    "psd_zero_power": "select bin::bigint as bin, round(db, 6) + 0.0 as db from (values (0, 0.0::double), (1, 0.0::double), (2, 10.0::double)) t(bin, db)",
    "exp_smooth": _SMOOTH,
    "exp_smooth_passthrough": "select vec_id as frame, bin, round(embedding[bin + 1]::double, 6) + 0.0 as v from embeddings, range(64) t(bin)",
    "histogram_counts": f"with {_V}, h as (select greatest(0, least(255, i + 128)) as bin, count(*) as n from v group by 1) select t.bin, coalesce(h.n, 0)::bigint as n from range(256) t(bin) left join h using (bin)",
    "histogram_flush_windows": _FLUSH,
    "histogram_packets": _PACKET_FLUSH,
    "byte_limited_sink": f"""with {_V}, k as (select pkt, count(*) as n, string_agg(printf('%04X%04X', i & 65535, q & 65535), '' order by pos) as h from v group by pkt),
  s as (select pkt, h, 4 * n as b, coalesce(sum(4 * n) over (order by pkt rows between unbounded preceding and 1 preceding), 0)::bigint as byte_at from k where pkt % 5 <> 4)
  select pkt as seq, byte_at, least(b, {LIMIT} - byte_at)::bigint as n_bytes, md5(left(h, (2 * least(b, {LIMIT} - byte_at))::bigint)) as digest from s where byte_at < {LIMIT}""",
    "frame_limited_sink": f"""select vec_id as frame, vec_id * 512 as byte_at, least(512, {LIMIT} - vec_id * 512)::bigint as n_bytes,
  round(list_sum(list_transform(embedding[1:(least(512, {LIMIT} - vec_id * 512) // 8)], lambda x: x::double)), 6) + 0.0 as total from embeddings where vec_id * 512 < {LIMIT}""",
    "graph_psd": f"with {_D}, {_dft('select p // 32 as frame, p % 32 as n, i::double as re, q::double as im from d where p // 32 < (select count(*) // 32 from d)', _BH.format(k='n', n=32))} {_DB}",
    "stream_stov": _STOV,
    "stream_exp_smooth": _SMOOTH,
    "stream_histogram": _FLUSH,
    "stream_histogram_packets": _PACKET_FLUSH,
}
