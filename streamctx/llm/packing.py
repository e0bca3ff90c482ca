"""Best-fit packing by the sum-of-squares rule.

Documents are tokenised whole; only those over the capacity are cut, and all pieces
but the first are full. A full piece is a sequence of its own. The others are
dealt by hash into groups of about `group` pieces. In a group, pieces go one by one,
longest first, to the open bin after which the sum over residual gaps of the
squared number of open bins with that gap is smallest (ties: to the smallest gap), or
to a new bin if none has room: a new bin at every chance costs sequences. Bins
that end less than `full` filled are emptied, and their pieces are packed again in
other mixtures, `rounds` times in all.

Null texts count as empty and are one end token. Rows with the same id, or none, are
packed each, whatever their number. Texts are read whole, white space of any length too. Columns besides the id and the text are not read,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from functools import cache, cached_property
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import staging, text

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Fixed value: the pre-tokenising pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space of the pattern's `\\s`, in runs too long for tiktoken.
LONG_WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{2000,}")


class Ids:
    """The ids that a tokenizers file gives to texts, as unsigned 32-bit numbers.

    A byte-level BPE vocabulary whose ids are in the order of its merges is handed to tiktoken, which gives
    the same ids several times faster; any other stays with tokenizers. Workers keep this, so tokenizers' own tables are
    made only when a text needs them.
    """

    def __init__(self, path: str):
        self.path, self.fast = path, None
        j = json.loads(Path(path).read_bytes())
        model, before = j["model"], j.get("pre_tokenizer") or {}
        special = {t["content"]: t["id"] for t in j.get("added_tokens") or []}
        plain = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True) and not j.get("normalizer") and model.get("type") == "BPE"
        plain = plain and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in j.get("added_tokens") or [])
        if plain and all(model["vocab"].get("".join(m)) == 256 + i for i, m in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"])):
            code = byte_codes()
            ranks = {bytes(code[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

        self.special = tuple(special)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def slow(self, doc: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(doc, add_special_tokens=False).ids, "<u4")

    def of(self, doc: str) -> np.ndarray:
        """The ids of a text of any length. tiktoken's pattern fails on white space of a million characters, so long runs of it go to tokenizers by themselves."""
        if not self.fast:
            return self.slow(doc)
        quick = lambda part: self.fast.encode_to_numpy(part, allowed_special="all").astype("<u4", copy=False)
        out, at = [], 0
        for run in LONG_WHITE.finditer(doc):
            # a run is one word, without its last character if text follows that isn't a special token
            end = run.end() - (run.end() < len(doc) and not doc.startswith(self.special, run.end()))
            out += [quick(doc[at : run.start()]), self.slow(doc[run.start() : end])]
            at = end
        return np.concatenate([*out, quick(doc[at:])]) if out else quick(doc)


def byte_codes() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable Latin-1 as it is, the others from 256 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def ids_of(path: str) -> Ids:
    return Ids(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECE rows of each row of docs. ids_crc32: of a piece's ids."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, doc in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = ids_of(tokenizer).of(doc or "").tobytes() + end
            at, k, total = 0, 0, len(ids) // 4
            while at < total:
                n = (total - 1) % capacity + 1 if not at else capacity
                for column, value in zip(out, (i, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])), strict=True):
                    column.append(value)
                at, k = at + n, k + 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(text.batches(cut), PIECE)


def place(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin, from 0, of each length, in the order given."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    count = np.zeros(capacity + 1, np.int64)
    out, bins = np.empty(len(lengths), np.int64), 0
    for at, n in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[n:capacity]) + n  # of open bins that have room
        if len(gaps):
            # the sum of squares changes by this where one bin leaves its gap for a smaller one; a full bin has none
            change = 1 - 2 * count[gaps] + np.where(gaps > n, 2 * count[gaps - n] + 1, 0)
            gap = int(gaps[np.argmin(change)])
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, bins = capacity, bins, bins + 1
        out[at] = b
        if gap > n:
            open_bins[gap - n].append(b)
            count[gap - n] += 1
    return out


def pack_group(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, placed longest first."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), np.int64)
    out[order] = place(lengths[order], capacity)
    return out


def packer(step: int, capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs the pieces of one deal. Sequence ids have the round in their lowest 2 bits, the bin in the next 30."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32", "row"], kind="stable")
        number, bins = int(rows.pop("deal").iloc[0]), pack_group(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = ((number << 30) + bins) * 4 + step
        sums = rows.groupby("sequence_id")["length"]
        rows["offset"], rows["filled"] = sums.cumsum() - rows["length"], sums.transform("sum")
        return rows

    return packed


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, *, group: int = 4000, full: float = 0.97, rounds: int = 3, **how: object) -> DataFrame:
    """PIECE columns, sequence_id and offset of each piece of each row of docs."""
    spark = docs.sparkSession
    # each piece has a number of its own, so that pieces of one id and text, or of none, are dealt apart
    todo = staging.stage(pieces(docs, tokenizer, capacity, **how).withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    done = todo.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() * 4 + 3).withColumn("offset", F.lit(0).cast("long"))
    todo = todo.where(F.col("length") < capacity)
    schema = f"{PIECE}, row long, sequence_id long, offset long, filled long"
    for step in range(rounds):
        last = step == rounds - 1
        n_groups = max(1, round(todo.count() / group))
        deal = F.pmod(F.xxhash64(F.lit(step), F.col("row")), F.lit(n_groups)).alias("deal")
        now = todo.select("*", deal).groupBy("deal").applyInPandas(packer(step, capacity), schema)
        if last:
            done = done.unionByName(now.drop("filled"))
            break
        now = staging.stage(now, f"pack-{step}")
        done = done.unionByName(now.where(F.col("filled") >= full * capacity).drop("filled"))
        todo = now.where(F.col("filled") < full * capacity).select(*[c.split()[0] for c in PIECE.split(", ")], "row")
        if n_groups == 1:  # nothing else to mix them with
            done = done.unionByName(now.where(F.col("filled") < full * capacity).drop("filled"))
            break
    return done.drop("row")
