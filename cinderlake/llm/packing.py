"""Packing token ids into training sequences: bounded-space online best fit, with a final merge of what is left.

A document is the ids of its whole text followed by ``end``.  Each partition streams its documents once and holds at most ``open_windows`` unfinished
windows of ``size`` ids.  A document's full windows are emitted as they are; its rest goes whole into the open window with the least
room that takes it.  Where none takes it and no further window may be opened, the fullest one is emitted, after its gap is filled
with the beginning of that document (documents may be cut, so an emitted window has no padding), and the remainder is placed again.

At the end of a partition the open windows are merged: pieces of the emptiest fill the fullest, so that one unfinished window is left.  The unfinished
windows of ``FAN`` partitions are merged by one task, the results again, until one is left; a task holds ``FAN`` windows.  The last one is cut
into runs whose lengths are powers of two, which need no padding: so no sequence is padded.

Ids are found by words: a text is cut where a single space stands between two characters that are no spaces or after white space and before
a character that is none; the tokenizer's own pattern always cuts there, so the ids of the parts are those of the whole text.  Parts seen lately are looked up in
two tables of about ``CACHE`` entries a worker, the others are encoded, many in one call.

A piece's row does not depend on time or attempt: a partition's rows come from the same files in the same order, and the pieces are written once.

Edge cases: a null or empty text is one id, ``end``; null ids and repeated rows are documents like others; a text of one unbroken run goes to the tokenizer whole; an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .textvec import pieces

SIZE, END, OPEN, FAN, CACHE, LONG = 2048, 1, 64, 256, 1 << 18, 48
TEXT, BATCH = 6 << 20, 4 << 20  # bytes of text encoded at once, and of ids in a batch of rows

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64())])
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long"

# a space beside white space: such a text is cut at its other spaces only
_WHITE = f"[{''.join(c for c in map(chr, range(0x3001)) if c.isspace())}]"
_CLOSE = f" {_WHITE}|{_WHITE} $"
_CUT = re.compile(r"(?<! ) (?=\S)")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, the same as ``Tokenizer.from_file(vocabulary)`` gives for the whole text.

    New parts of up to ``LONG`` characters are joined by spaces, encoded in one call by the same vocabulary's ``ranks`` (half of the time all in all) and told apart by the tokens' lengths;
    longer ones, and those that may hold an added token, are encoded one by one by the tokenizer.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as f:
            of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.width = np.zeros(max(of.values()) + 1, np.int64)
        for token, i in of.items():
            self.width[i] = len(token)
        self.short = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=of, special_tokens={})
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # ids of parts that follow a space; what is not asked for while ``CACHE`` others come in is forgotten
        self.after: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, parts: list[str]) -> list[bytes]:
        """Of short parts, each after a space; the tokenizer cuts before each of these spaces."""
        if not parts:
            return []
        ids = np.array(self.short.encode_ordinary(" " + " ".join(parts)), "<u4")
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, parts)), np.int64) + 1)
        cuts = 4 * (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False)]

    def _found(self, parts: list[str], odd: bool = False) -> list[bytes]:
        """The ids of distinct parts, each after a space; ``odd`` ones may hold a special token or end in a space."""
        if len(self.after) > CACHE:
            self.after, self.older = {}, self.after
        out = list(map(self.after.get, parts))
        missing = [i for i, v in enumerate(out) if v is None]
        out_of = dict(zip((parts[i] for i in missing), map(self.older.get, (parts[i] for i in missing)), strict=True))
        new = [x for x, v in out_of.items() if v is None]
        alone = [x for x in new if not 0 < len(x) <= LONG or odd and (x[-1] == " " or any(s in x for s in self.special))]
        joined = list(set(new).difference(alone)) if alone else new
        out_of.update(zip(joined, self._joined(joined), strict=True))
        self.after.update(out_of)
        for x, ids in zip(alone, self._alone([f" {x}" for x in alone]), strict=True):
            out_of[x] = ids
            del self.after[x]
        for i in missing:
            out[i] = out_of[parts[i]]
        return out

    def _plain(self, texts: pa.Array) -> list[bytes]:
        """Each distinct part is looked up once; a text's ids are gathered by its parts' numbers."""
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        at = at - at[0]
        coded = flat.dictionary_encode()
        known, which = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        which[at[:-1]] = len(known) + np.arange(len(texts))
        found = self._found(known) + self._alone(flat.take(pa.array(at[:-1])).to_pylist())
        ids, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64) // 4
        begin = np.cumsum(size) - size
        end = np.cumsum(size[which])
        ids = ids[np.repeat(begin[which] - end + size[which], size[which]) + np.arange(end[-1])]
        cuts = np.append(0, end)[at].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def __call__(self, column: pa.Array) -> list[bytes]:
        """``column``: strings without nulls."""
        odd = pc.match_substring_regex(column, _CLOSE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(column, s))
        plain = column.filter(pc.invert(odd))
        known = iter(self._plain(plain) if len(plain) else [])
        out = []
        for i, o in enumerate(odd.to_pylist()):
            if o:
                first, *rest = _CUT.split(column[i].as_py())
                table = list(set(rest))
                ids = dict(zip(table, self._found(table, True), strict=True))
                out.append(b"".join([*self._alone([first]), *map(ids.__getitem__, rest)]))
            else:
                out.append(next(known))
        return out


@lru_cache(maxsize=1)
def encoder(vocabulary: str, ranks: str, pattern: str) -> Encoder:
    """A worker's tasks share one."""
    return Encoder(vocabulary, ranks, pattern)


class Packer:
    """One partition's open windows.  A window is a list of pieces (doc_id, start, ids, doc_tokens); ``done`` gets each full one."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.windows: list[tuple[int, list]] = []  # (room, pieces)
        self.done: list[list] = []

    def add(self, doc_id: int | None, ids: bytes, start: int = 0, total: int | None = None) -> None:
        """Place ``ids`` (4 bytes each), which begin at place ``start`` of a document of ``total`` ids."""
        total = len(ids) // 4 if total is None else total
        while len(ids) >= 4 * self.size:
            self.done.append([(doc_id, start, ids[: 4 * self.size], total)])
            ids, start = ids[4 * self.size :], start + self.size
        while ids:
            n = len(ids) // 4
            best = min((i for i, (room, _) in enumerate(self.windows) if room >= n), key=lambda i: self.windows[i][0], default=None)
            if best is None and len(self.windows) < self.most:
                self.windows.append((self.size - n, [(doc_id, start, ids, total)]))
                return
            if best is None:  # the fullest one is filled with a beginning of this document and emitted
                best = min(range(len(self.windows)), key=lambda i: self.windows[i][0])
            room, pieces = self.windows.pop(best)
            n = min(n, room)
            pieces.append((doc_id, start, ids[: 4 * n], total))
            ids, start = ids[4 * n :], start + n
            if n == room:
                self.done.append(pieces)
            else:
                self.windows.append((room - n, pieces))

    def merge(self) -> None:
        """Fill the fullest windows with pieces of the emptiest until at most one is open."""
        self.windows.sort(key=lambda w: w[0])
        while len(self.windows) > 1:
            room, pieces = self.windows.pop(0)
            while room and self.windows:
                far, rest = self.windows.pop()
                doc_id, start, ids, total = rest.pop()
                n = min(room, len(ids) // 4)
                # a piece that does not fit gives its end, so that its beginning stays where it is
                pieces.append((doc_id, start + len(ids) // 4 - n, ids[len(ids) - 4 * n :], total))
                if len(ids) > 4 * n:
                    rest.append((doc_id, start, ids[: len(ids) - 4 * n], total))
                room -= n
                if rest:
                    self.windows.append((far + n, rest))
            if room:
                self.windows.insert(0, (room, pieces))
            else:
                self.done.append(pieces)


def powers(pieces: list) -> list[list]:
    """Cut a window into runs whose lengths are the powers of two of its length, longest first."""
    left = sum(len(p[2]) // 4 for p in pieces)
    out: list[list] = []
    todo = list(reversed(pieces))
    while left:
        need, run = 1 << (left.bit_length() - 1), []
        left -= need
        while need:
            doc_id, start, ids, total = todo.pop()
            n = min(need, len(ids) // 4)
            run.append((doc_id, start, ids[: 4 * n], total))
            if len(ids) > 4 * n:
                todo.append((doc_id, start + n, ids[4 * n :], total))
            need -= n
        out.append(run)
    return out


class Rows:
    """Rows of sequences; those with ``part`` set are an unfinished window's."""

    def __init__(self, base: int):
        self.next, self.bytes, self.rows = base, 0, []

    def put(self, pieces: list, part: int | None = None) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, total, self.next, at, part))
            at += n
            self.bytes += len(ids) + 64
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.bytes = self.rows, [], 0
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(SCHEMA)], schema=SCHEMA)


def pack(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, size: int = SIZE, end: int = END, open_windows: int = OPEN, fan: int = FAN) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: a row a piece.

    ``vocabulary`` is the tokenizer's file, ``ranks`` the same vocabulary's byte strings and ranks, ``pattern`` what cuts a text into words.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    last = np.array([end], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary, ranks, pattern), Packer(size, open_windows)
        me = TaskContext.get().partitionId()
        rows = Rows(me << 32)

        def full() -> Iterator[pa.RecordBatch]:
            while packer.done:
                rows.put(packer.done.pop())
                if rows.bytes > BATCH:
                    yield rows.batch()

        for batch in batches:
            for a, b in pieces(batch.column("text"), TEXT):
                part = batch.slice(a, b - a)
                texts = pc.fill_null(part.column("text"), "")
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                    packer.add(doc_id, ids + last)
                    yield from full()
        packer.merge()
        yield from full()
        for _, window in packer.windows:
            rows.put(window, me)
        yield rows.batch()

    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = scratch.keep(ids.mapInArrow(first, DDL), "packed", compression="zstd")
    done, left = [packed.filter("part IS NULL")], packed.filter("part IS NOT NULL")
    parts = left.agg(F.max("part")).first()[0]
    level = 1
    while parts is not None:  # a round has a task for each ``fan`` unfinished windows
        only = parts < fan

        def again(key, t):
            packer, me = Packer(size, 1 << 30), key[0].as_py()
            rows = Rows((level << 56) | (me << 32))
            t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            seq, held = t.column("sequence_id").to_pylist(), []
            for i, p in enumerate(zip(*(t.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)):
                held.append(p)
                if i + 1 == len(seq) or seq[i + 1] != seq[i]:
                    packer.windows.append((size - sum(len(x[2]) // 4 for x in held), held))
                    held = []
            packer.merge()
            for w in packer.done:
                rows.put(w)
            for _, w in packer.windows:
                for run in powers(w) if only else [w]:
                    rows.put(run, None if only else me)
            return pa.Table.from_batches([rows.batch()])

        merged = left.withColumn("part", F.floor(F.col("part") / fan)).groupBy("part").applyInArrow(again, DDL)
        merged = scratch.keep(merged, f"merged-{level}")
        done.append(merged.filter("part IS NULL"))
        left, parts, level = merged.filter("part IS NOT NULL"), None if only else parts // fan, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    packed = pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
