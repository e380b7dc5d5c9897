"""Codecs of a partition's unfinished offsets.

The range from the committed offset to the highest succeeded one is encoded as
a bitset or as run lengths, the shortest form is marked by a magic byte and
written as Base64.  All work is on runs, never on the offsets of the range, but
for the bytes of a bitset that is really written.  Run lengths and sizes are
relational; bytes and compressed sizes need Python.
"""

from __future__ import annotations

import base64
import gzip
import struct
import time
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import METADATA_LIMIT, PRESSURE, ForeignMetadata

# The magic byte of each encoding.
MAGIC = {
    "ByteArray": 0x4C, "ByteArrayCompressed": 0xEE, "BitSet": 0x6C, "BitSetCompressed": 0x61, "RunLength": 0x6E, "RunLengthCompressed": 0x4A,
    "BitSetV2": 0x6F, "BitSetV2Compressed": 0x73, "RunLengthV2": 0x65, "RunLengthV2Compressed": 0x70, "KafkaStreams": 1, "KafkaStreamsV2": 2,
}
NAME = {v: k for k, v in MAGIC.items()}
#: In the order in which equal sizes are preferred.
PLAIN = ("BitSet", "BitSetV2", "RunLength", "RunLengthV2")
#: Compressed forms are tried only if no plain one is shorter.
SMALL = 200
SHORT, INT = 2**15 - 1, 2**31 - 1


def base_and_length(committed: int, highest_succeeded: int) -> tuple[int, int]:
    """The offset that bit 0 stands for, and the number of bits."""
    highest = committed if highest_succeeded == -1 else highest_succeeded
    return committed, max(highest, committed - 1) - committed + 1


def bits_of(base: int, length: int, todo: Iterable[int]) -> np.ndarray:
    """True for complete offsets."""
    done = np.ones(length, bool)
    at = np.array([x - base for x in todo if 0 <= x - base < length], np.int64)
    done[at] = False
    return done


def runs_of(done: np.ndarray) -> list[int]:
    """Lengths of alternating runs, the first of incomplete offsets (0 if there is none)."""
    return runs_between(0, len(done), np.flatnonzero(~done))


def runs_between(base: int, length: int, todo: Iterable[int]) -> list[int]:
    """The same from the incomplete offsets alone."""
    if not length:
        return []
    at = np.unique(np.array(list(todo), np.int64)) - base
    at = at[(at >= 0) & (at < length)]
    if not len(at):
        return [0, length]
    first = np.flatnonzero(np.append(True, np.diff(at) > 1))
    begins, ends = at[first], at[np.append(first[1:], len(at)) - 1] + 1
    edges = np.column_stack([begins, ends]).ravel()
    runs = np.diff(np.append(edges, length)).tolist()
    if not runs[-1]:
        runs.pop()
    return [0, int(begins[0]), *runs] if begins[0] else runs


def runs_with_gaps(marks: Iterable[tuple[int, bool]]) -> list[int]:
    """Run lengths of (offset, complete) in order; offsets that are not there belong to the run before them."""
    marks = list(marks)
    if not marks:
        return []
    offs = np.array([o for o, _ in marks])
    done = np.array([d for _, d in marks])
    return runs_of(np.repeat(done, np.diff(np.append(offs, offs[-1] + 1))))


def plain_sizes(length: int, runs: list[int]) -> dict[str, int]:
    """Bytes of each plain encoding that can hold the range."""
    longest = max(runs, default=0)
    each = {"BitSet": (2 + -(-length // 8) + 1, length <= SHORT), "BitSetV2": (4 + -(-length // 8) + 1, length <= INT), "RunLength": (2 * len(runs), longest <= SHORT), "RunLengthV2": (4 * len(runs), longest <= INT)}
    return {k: n for k, (n, fits) in each.items() if fits}


def encode_body(name: str, done: np.ndarray | list[int]) -> bytes | None:
    """The bytes of a plain encoding, from bits or from runs; None where it cannot hold the range."""
    runs = runs_of(done) if isinstance(done, np.ndarray) else done
    n = int(sum(runs))
    if name not in plain_sizes(n, runs):
        return None
    if name in ("BitSet", "BitSetV2"):
        packed = np.packbits(np.repeat(np.arange(len(runs)) % 2 == 1, runs), bitorder="little").tobytes()
        return struct.pack(">h" if name == "BitSet" else ">i", n) + packed + b"\0"
    return np.array(runs, ">i2" if name == "RunLength" else ">i4").tobytes()


def smallest(length: int, runs: list[int], forced: str | None = None) -> tuple[str, bytes]:
    """The shortest encoding and its bytes; compressed ones are tried only if no plain one is under SMALL."""
    sizes = plain_sizes(length, runs)
    if forced is not None:
        plain = forced.removesuffix("Compressed")
        if plain not in sizes:
            raise ValueError(f"{forced} cannot hold {length} offsets")
        body = encode_body(plain, runs)
        return forced, zstandard.ZstdCompressor().compress(body) if forced.endswith("Compressed") else body
    if not sizes:
        raise ValueError(f"no encoding holds {length} offsets")
    name = min(sizes, key=lambda k: sizes[k])
    if sizes[name] < SMALL:
        return name, encode_body(name, runs)
    forms = {k: encode_body(k, runs) for k in sizes}
    forms |= {f"{k}Compressed": zstandard.ZstdCompressor().compress(v) for k, v in forms.items()}
    name = min(forms, key=lambda k: len(forms[k]))
    return name, forms[name]


def encode(committed: int, highest_succeeded: int, todo: Iterable[int], forced: str | None = None) -> str:
    """Base64 of the shortest encoding, with its magic byte."""
    base, n = base_and_length(committed, highest_succeeded)
    name, body = smallest(n, runs_between(base, n, todo), forced)
    return base64.b64encode(bytes([MAGIC[name]]) + body).decode()


class ForeignPayload(ValueError):
    """Metadata of another kind of consumer."""


def decode(committed: int, metadata: str | None, foreign: ForeignMetadata = ForeignMetadata.FAIL) -> tuple[int, list[int]]:
    """(highest seen, incomplete offsets) of a commit; without metadata all below the committed offset is done."""
    if not metadata:
        return committed - 1, []
    raw = base64.b64decode(metadata)
    name, body = NAME.get(raw[0]), raw[1:]
    if name is None:
        raise ValueError(f"unknown magic {raw[0]}")
    if name.startswith("KafkaStreams"):
        if foreign is ForeignMetadata.FAIL:
            raise ForeignPayload("the metadata belongs to another kind of consumer")
        return committed, []
    if name.startswith("ByteArray"):
        raise ValueError("byte arrays are not decoded")
    if name.endswith("Compressed"):
        name, body = name.removesuffix("Compressed"), zstandard.ZstdDecompressor().decompressobj().decompress(body)
    if name.startswith("BitSet"):
        head = 2 if name == "BitSet" else 4
        n = int.from_bytes(body[:head], "big", signed=True)
        bits = np.unpackbits(np.frombuffer(body[head:], np.uint8), bitorder="little")
        done = np.zeros(n, bool)
        done[: min(n, len(bits))] = bits[:n]
    else:
        runs = np.frombuffer(body, ">i2" if name == "RunLength" else ">i4").astype(np.int64)
        begins = np.cumsum(runs) - runs
        todo = [np.arange(b, b + n) for b, n in zip(begins[::2], runs[::2])]
        return committed + int(runs.sum()) - 1, (committed + np.concatenate(todo)).tolist() if todo else []
    return committed + n - 1, (committed + np.flatnonzero(~done)).tolist()


def decode_or_none(committed: int, metadata: str | None, foreign: ForeignMetadata = ForeignMetadata.FAIL) -> tuple[int, list[int]]:
    """The same, but metadata that cannot be read counts as none."""
    try:
        return decode(committed, metadata, foreign)
    except ForeignPayload:
        raise
    except (ValueError, IndexError, struct.error, zstandard.ZstdError):
        return decode(committed, None)


#: Codecs that payloads are compared with, as (pack, unpack).
HELPERS = {
    "gzip": (gzip.compress, gzip.decompress),
    "snappy": (lambda b: pa.compress(b, "snappy", asbytes=True), lambda b, n: pa.decompress(b, n, "snappy", asbytes=True)),
    "zstd": (lambda b: zstandard.ZstdCompressor().compress(b), lambda b: zstandard.ZstdDecompressor().decompress(b)),
}


def byte_array(done: np.ndarray) -> bytes:
    """One byte for each offset, 1 for complete: a form that is compared with, but never chosen."""
    return done.astype(np.uint8).tobytes()


def picture(done: np.ndarray) -> str:
    """x for complete, o for incomplete."""
    return "".join("x" if d else "o" for d in done)


def from_picture(base: int, xo: str) -> list[int]:
    return [base + i for i, c in enumerate(xo) if c == "o"]


def encode_udf():
    @F.pandas_udf("string")
    def run(committed: pd.Series, highest: pd.Series, todo: pd.Series) -> pd.Series:
        return pd.Series([encode(int(c), int(h), t if t is not None else []) for c, h, t in zip(committed, highest, todo)])

    return run


def decode_udf(foreign: ForeignMetadata = ForeignMetadata.FAIL):
    @F.pandas_udf("highest_seen long, incompletes array<long>")
    def run(committed: pd.Series, metadata: pd.Series) -> pd.DataFrame:
        rows = [decode(int(c), m, foreign) for c, m in zip(committed, metadata)]
        return pd.DataFrame({"highest_seen": [r[0] for r in rows], "incompletes": [r[1] for r in rows]})

    return run


# The relational forms.


def run_lengths(work: DataFrame, state: DataFrame) -> DataFrame:
    """(topic, part, run, done, begins, n): alternating runs in order, from the commit to the highest succeeded offset; an empty first run is left out.

    Islands of incomplete offsets, and what lies between them: gaps count as done.
    The range itself is never made, so it may be of any length.
    """
    s = state.where("highest_succeeded >= to_commit").select("topic", "part", "to_commit", "highest_succeeded")
    todo = work.where("not succeeded").select("topic", "part", "off").distinct().join(s, ["topic", "part"]).where("off between to_commit and highest_succeeded")
    by = Window.partitionBy("topic", "part").orderBy("off")
    islands = todo.withColumn("island", F.col("off") - F.row_number().over(by)).groupBy("topic", "part", "to_commit", "highest_succeeded", "island").agg(F.min("off").alias("a"), F.max("off").alias("b"))
    order = Window.partitionBy("topic", "part").orderBy("a")
    islands = islands.withColumn("next", F.coalesce(F.lead("a").over(order), F.col("highest_succeeded") + 1)).withColumn("before", F.lag("b").over(order))
    pieces = F.expr("""filter(array(
        named_struct('done', true, 'begins', 0L, 'n', if(before is null, a - to_commit, 0L)),
        named_struct('done', false, 'begins', a - to_commit, 'n', b - a + 1),
        named_struct('done', true, 'begins', b + 1 - to_commit, 'n', next - b - 1)), p -> p.n > 0)""")
    whole = s.join(islands.select("topic", "part").distinct(), ["topic", "part"], "left_anti").select("topic", "part", F.lit(True).alias("done"), F.lit(0).cast("long").alias("begins"), (F.col("highest_succeeded") - F.col("to_commit") + 1).alias("n"))
    runs = islands.select("topic", "part", F.inline(pieces)).union(whole)
    return runs.withColumn("run", F.row_number().over(Window.partitionBy("topic", "part").orderBy("begins")).cast("long")).select("topic", "part", "run", "done", "begins", "n")


def pictures(work: DataFrame, state: DataFrame) -> DataFrame:
    """(topic, part, xo) from runs, so that a row a run is gathered and not a row an offset."""
    r = run_lengths(work, state)
    piece = F.struct("run", F.expr("repeat(if(done, 'x', 'o'), int(n))").alias("s"))
    return r.groupBy("topic", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["s"]), "").alias("xo"))


def decode_runs(runs: DataFrame, state: DataFrame) -> DataFrame:
    """Incomplete offsets from runs: where each begins is a running sum."""
    w = Window.partitionBy("topic", "part").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    r = runs.withColumn("at", F.coalesce(F.sum("n").over(w), F.lit(0)))
    r = r.where("not done").join(state.select("topic", "part", "to_commit"), ["topic", "part"])
    return r.select("topic", "part", F.explode(F.sequence(F.col("to_commit") + F.col("at"), F.col("to_commit") + F.col("at") + F.col("n") - 1)).alias("off"))


def sizes(work: DataFrame, state: DataFrame, compress: bool = True) -> DataFrame:
    """(topic, part, encoding, rank, size): bytes of each plain encoding that can hold the range, and of compressed ones where none of these is under SMALL.

    Without ``compress`` there are plain ones only, whatever their size; these need no Python and no list of runs.
    """
    s = state.where("highest_succeeded >= to_commit").select("topic", "part", (F.col("highest_succeeded") - F.col("to_commit") + 1).alias("bits"))
    # A range that begins with a complete offset has an empty first run.
    all_runs = run_lengths(work, state)
    r = all_runs.groupBy("topic", "part").agg((F.count("*") + F.max(F.expr("if(begins = 0 and done, 1, 0)"))).alias("runs"), F.max("n").alias("longest"))
    each = F.expr(
        f"""filter(array(
            named_struct('encoding', 'BitSet', 'rank', 0, 'size', 2 + (bits + 7) div 8 + 1, 'fits', bits <= {SHORT}),
            named_struct('encoding', 'BitSetV2', 'rank', 1, 'size', 4 + (bits + 7) div 8 + 1, 'fits', bits <= {INT}),
            named_struct('encoding', 'RunLength', 'rank', 2, 'size', 2 * runs, 'fits', longest <= {SHORT}),
            named_struct('encoding', 'RunLengthV2', 'rank', 3, 'size', 4 * runs, 'fits', longest <= {INT})), e -> e.fits)"""
    )
    forms = s.join(r, ["topic", "part"]).select("topic", "part", each.alias("forms"))
    plain = forms.select("topic", "part", F.inline("forms")).drop("fits")
    if not compress:
        return plain
    long = forms.where(f"forall(forms, e -> e.size >= {SMALL})").select("topic", "part")

    @F.pandas_udf("array<struct<encoding: string, rank: int, size: bigint>>")
    def compressed(runs: pd.Series) -> pd.Series:
        out = []
        for x in runs:
            n = [int(v) for v in x]
            made = [(k, encode_body(k, n)) for k in PLAIN]
            out.append([{"encoding": f"{k}Compressed", "rank": len(PLAIN) + PLAIN.index(k), "size": len(zstandard.ZstdCompressor().compress(b))} for k, b in made if b is not None])
        return pd.Series(out)

    # What a commit holds: a list of runs for each partition.
    lists = all_runs.join(long, ["topic", "part"], "left_semi").groupBy("topic", "part").agg(F.sort_array(F.collect_list(F.struct("run", "done", "n"))).alias("r"))
    lists = lists.select("topic", "part", F.expr("concat(if(r[0].done, array(0L), cast(array() as array<bigint>)), transform(r, x -> x.n))").alias("runs"))
    return plain.unionByName(lists.select("topic", "part", F.inline(compressed("runs"))))


def choose(sized: DataFrame) -> DataFrame:
    """The shortest encoding of each partition; of equal ones the first by rank."""
    best = sized.groupBy("topic", "part").agg(F.min(F.struct("size", "rank", "encoding")).alias("b"))
    return best.select("topic", "part", "b.encoding", "b.size", chars("b.size").alias("chars"))


def chars(size: str) -> Column:
    """Base64 characters of a magic byte and ``size`` bytes."""
    return F.expr(f"4 * ((1 + {size} + 2) div 3)")


def pressure(chosen: DataFrame, limit: int = METADATA_LIMIT, share: float = PRESSURE, incompletes: str | None = None) -> DataFrame:
    """``outcome``: a payload that is too long is stripped and blocks; a long one is kept and blocks; else records may be taken.

    ``incompletes``: SQL for how many offsets are incomplete; where none is, nothing is written and records may be taken.
    """
    out = F.when(F.col("chars") > limit, "strip and block").when(F.col("chars") > limit * share, "keep and block").otherwise("allow")
    return chosen.withColumn("outcome", out if incompletes is None else F.when(F.expr(f"{incompletes} = 0"), "nothing to keep").otherwise(out))


def payloads(state: DataFrame, todo: DataFrame, limit: int = METADATA_LIMIT, share: float = PRESSURE, forced: str | None = None) -> DataFrame:
    """(topic, part, to_commit, highest_succeeded, metadata, encoding, chars, encoding_us, allowed, payload): what each partition would commit.

    Only incomplete offsets below the highest succeeded one are kept.  A list of a
    partition's incompletes is what the payload holds.  Without any there is no
    payload; one that is too long is left out of the metadata, and it or a long one
    stops the partition from taking records above its highest succeeded offset.
    ``payload`` is the whole one, however long: what changes are told by, and what a
    store without a limit may keep.
    """
    top = state.select("topic", "part", "to_commit", "highest_succeeded")
    lists = todo.select("topic", "part", "off").distinct().join(top, ["topic", "part"]).where("off < highest_succeeded").groupBy("topic", "part").agg(F.sort_array(F.collect_list("off")).alias("todo"))

    @F.pandas_udf("metadata string, encoding string, encoding_us long")
    def run(committed: pd.Series, highest: pd.Series, todo: pd.Series) -> pd.DataFrame:
        rows = []
        for c, h, t in zip(committed, highest, todo):
            if t is None or not len(t):
                rows.append((None, None, None))
                continue
            began = time.perf_counter_ns()
            data = encode(int(c), int(h), t, forced)
            rows.append((data, NAME[base64.b64decode(data[:4])[0]], (time.perf_counter_ns() - began) // 1000))
        return pd.DataFrame(rows, columns=["metadata", "encoding", "encoding_us"])

    made = top.join(lists, ["topic", "part"], "left").withColumn("p", run("to_commit", "highest_succeeded", "todo"))
    n = F.coalesce(F.length("p.metadata"), F.lit(0))
    return made.select("topic", "part", "to_commit", "highest_succeeded", F.when(n <= limit, F.col("p.metadata")).alias("metadata"), "p.encoding", n.alias("chars"), "p.encoding_us", (n <= limit * share).alias("allowed"), F.col("p.metadata").alias("payload"))
