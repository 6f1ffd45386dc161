"""Chat formatting: speaker roles of transcripts recovered by a hidden Markov model, then canonical turns.

A transcript is an ordered list of lines.  Hidden states are (role, first line of a turn or a later one).  Each
line is observed as one symbol made of its speaker marker (which role a leading ``User:``, ``Human -``, ``### Assistant`` ... names, or none) and line features (its
length class, whether it ends in a question mark, whether the line before it is blank).  Start, transition and symbol probabilities are
counted, with add-``smooth`` smoothing, from turns with known roles; the counts are one aggregation to a table of fixed size (states times symbols).  Viterbi
then gives the most probable roles of all lines, which are joined into turns and rendered as ``<|role|>\\ntext<|end|>``.

Long conversations: Viterbi is a product of (max, +) matrices, one a line.  Turns are put in order by one range sort and
cut into chunks of up to ``chunk_turns`` turns as they lie, whatever their turn numbers are; a chunk's matrix
(states by states) stands for all its lines, chunks are numbered within their conversation and combined in levels of ``ways`` until each conversation has one, and best states then go
back down the levels.  So no task holds a whole hot conversation, and the result is exactly that of one pass.  What a task holds is a chunk's text: its longest is ``chunk_turns`` turns.

Edge cases: null text is one empty line; a null turn number sorts first (as turn -1); turns with equal numbers are ordered by role and a hash of the text; repeated rows are turns
of their own; a null conv_id is a conversation of its own; unknown or null roles count as unmarked and their roles are recovered; an empty table gives no rows; extra
columns are ignored.  Without known roles the model is uniform and unmarked lines continue the turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table, whole_groups

ROLES = ("system", "user", "assistant")
#: Names that transcripts use for a role.
NAMES = {"system": "system", "instruction": "system", "user": "user", "human": "user", "customer": "user", "q": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "a": "assistant"}
MARKER = re.compile(r"\s*(?:[#>*\[(<|]+\s*)?(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")\s*(?:[\])>*|]+\s*:?|:|-)\s*", re.IGNORECASE)
BEGIN = 2 * len(ROLES)  # before the first line; other states are role * 2 + (0: first line of a turn, 1: later)
STATES = BEGIN + 1
MARKS, LENGTHS = 1 + len(ROLES), 4
SYMBOLS = MARKS * LENGTHS * 2 * 2
SMOOTH, CHUNK_TURNS, WAYS, LOST = 0.1, 64, 256, 3
END = "<|end|>"
NO_CONV = "\0null"  # the text that stands for a null id while conversations are keyed


def read_line(line: str, after_blank: bool) -> tuple[int, str]:
    """(symbol, the line without its marker); ``after_blank``: the line before it is blank."""
    m = MARKER.match(line)
    mark = 1 + ROLES.index(NAMES[m[1].lower()]) if m else 0
    body = line[m.end() :] if m else line
    n = len(body)
    length = 0 if n == 0 else 1 if n < 60 else 2 if n < 240 else 3
    asks = body.rstrip().endswith("?")
    return ((mark * LENGTHS + length) * 2 + asks) * 2 + after_blank, body


def symbols(lines: list[str], after_blank: bool) -> tuple[np.ndarray, list[str]]:
    got = [read_line(x, not lines[k - 1].strip() if k else after_blank) for k, x in enumerate(lines)]
    return np.array([g[0] for g in got], np.int64), [g[1] for g in got]


class Model:
    """Log probabilities: move (states, states; from ``BEGIN`` the start probabilities) and say (states, symbols)."""

    def __init__(self, counts: dict[tuple[str, int, int], int], smooth: float = SMOOTH):
        move, say = np.full((STATES, STATES), smooth), np.full((STATES, SYMBOLS), smooth)
        for (kind, i, j), n in counts.items():
            (move if kind == "move" else say)[i, j] += n
        move[:, BEGIN] = 0
        for r in range(len(ROLES)):  # a later line follows its own turn only
            move[[s for s in range(STATES) if s // 2 != r], r * 2 + 1] = 0
        # a marker names its role and opens a turn
        mark = np.arange(SYMBOLS) // (LENGTHS * 4)
        for s in range(BEGIN):
            say[s, (mark > 0) & ((mark - 1 != s // 2) | (s % 2 == 1))] *= 1e-6
        with np.errstate(divide="ignore"):
            self.move, self.say = np.log(move / move.sum(1, keepdims=True)), np.log(say / say.sum(1, keepdims=True))

    def step(self, symbol: int) -> np.ndarray:
        """(state before, state now) scores of one line."""
        return self.move + self.say[:, symbol][None, :]

    def matrix(self, syms: np.ndarray) -> np.ndarray:
        """The (max, +) product of the lines' steps."""
        total = np.full((STATES, STATES), -np.inf)
        np.fill_diagonal(total, 0.0)
        for s in syms:
            total = (total[:, :, None] + self.step(s)[None]).max(axis=1)
        return total

    def path(self, steps: list[np.ndarray], entry: np.ndarray, last: int | None) -> list[int]:
        """States after each step, given scores of the states before the first and, if known, the state after the last."""
        score, back = entry, []
        for m in steps:
            ways = score[:, None] + m
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        state = int(score.argmax()) if last is None else last
        out = []
        for b in reversed(back):
            out.append(state)
            state = int(b[state])
        return out[::-1]


def transcript(conversations: DataFrame, lost: int = LOST) -> DataFrame:
    """conv_id, turn, line, role, marked: each turn as transcript text with a speaker marker; one in ``lost`` turns (by hash) has lost its
    marker, as turns without a known role have."""
    role = F.lower(F.trim("role"))
    known = F.when(role.isin(*NAMES), F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), role))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    gone = (F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), turn.cast("string")).cast("binary")) % lost) == 0
    rows = conversations.select("conv_id", turn.alias("turn"), known.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    marked = F.col("role").isNotNull() & ~gone
    # turns are set apart by a blank line
    return rows.withColumn("marked", marked).withColumn("text", F.concat(F.when(marked, F.concat(F.initcap("role"), F.lit(": "))).otherwise(F.lit("")), F.col("text"), F.lit("\n")))


def numbered(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """conv, c, pos, role, marked, text, chunk, head, tail: turns in order (``pos``), ``c`` a chunk's key, ``chunk`` its number in the conversation, head and tail its ends.

    Equal turns are told apart at random, so that a range never holds too many of them.  A range's rows are numbered as they lie, so a
    conversation's chunks in a range have consecutive keys, and begin where those of its earlier ranges end.
    """
    scratch = Scratch(turns.sparkSession, "chat-turns")
    order = ["conv", "turn", F.col("role").asc_nulls_first(), "mark", "tie"]
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(NO_CONV)).alias("conv"), "turn", "role", "marked", "text", F.xxhash64("text").alias("mark"), F.rand(5).alias("tie"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    rows = scratch.keep(rows.select("conv", "pos", "role", "marked", "text", F.expr(f"pos div {chunk_turns}").alias("c")), "turns")
    chunks = rows.groupBy("conv", "c").agg(F.min("pos").alias("head"), F.max("pos").alias("tail")).withColumn("range", F.shiftright("head", 33))
    ranges = chunks.groupBy("conv", "range").agg(F.count("*").alias("n"), F.min("c").alias("low"))
    begin = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("conv", "range", (begin - F.col("low")).alias("shift"))
    chunks = chunks.join(ranges, ["conv", "range"]).select("conv", "c", "head", "tail", (F.col("c") + F.col("shift")).alias("chunk"))
    return rows.join(scratch.keep(chunks, "chunks"), ["conv", "c"])


def count(turns: DataFrame) -> dict[tuple[str, int, int], int]:
    """Counts for ``Model`` from ``numbered`` turns with roles: within turns in one pass, between turns from lines' ends, within a chunk and across its borders."""
    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move, say = np.zeros((STATES, STATES), np.int64), np.zeros((STATES, SYMBOLS), np.int64)
        for batch in batches:
            for role, text, opens in zip(*(batch.column(c).to_pylist() for c in ("role", "text", "opens")), strict=True):
                first = ROLES.index(role) * 2
                syms, _ = symbols(text.split("\n"), not opens)
                say[first, syms[0]] += 1
                np.add.at(say[first + 1], syms[1:], 1)
                move[first, first + 1] += len(syms) > 1
                move[first + 1, first + 1] += max(0, len(syms) - 2)
        found = [("move", i, j, move[i, j]) for i, j in zip(*np.nonzero(move), strict=True)] + [("say", i, j, say[i, j]) for i, j in zip(*np.nonzero(say), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["kind", "i", "j", "n"])

    schema = "kind string, i int, j int, n long"
    opens = (F.col("chunk") == 0) & (F.col("pos") == F.col("head"))
    inner = turns.filter("role IS NOT NULL").select("role", "text", opens.alias("opens")).mapInArrow(within, schema)
    state = F.when(F.col("role").isNotNull(), F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1) * 2
    many = F.instr("text", "\n") > 0
    ends = turns.select("conv", "c", "chunk", "pos", "head", "tail", state.alias("first"), (state + many.cast("int")).alias("last"))
    moves = lambda df, before: df.filter(f"{before} IS NOT NULL AND first IS NOT NULL").groupBy(F.lit("move").alias("kind"), F.col(before).alias("i"), F.col("first").alias("j")).agg(F.count("*").alias("n"))
    inside = ends.withColumn("before", F.lag("last").over(W.partitionBy("conv", "c").orderBy("pos")))
    tails = ends.filter("pos = tail").select("conv", (F.col("chunk") + 1).alias("chunk"), F.col("last").alias("before"))
    across = ends.filter("pos = head").join(tails, ["conv", "chunk"])
    starts = ends.filter("chunk = 0 AND pos = head").withColumn("start", F.lit(BEGIN))
    total = inner.union(moves(inside, "before")).union(moves(across, "before")).union(moves(starts, "start")).groupBy("kind", "i", "j").agg(F.sum("n").alias("n"))
    return {(r["kind"], r["i"], r["j"]): r["n"] for r in total.collect()}  # states * (states + symbols) rows at most


KEYS = ["conv", "chunk"]


def _pack(m: np.ndarray) -> bytes:
    return m.astype(np.float64).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b).reshape(STATES, STATES)


def _sorted_groups(df: DataFrame, keys: list[str], order: list[str], run, schema: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def recover(turns: DataFrame, model: Model, ways: int = WAYS) -> DataFrame:
    """conv, chunk, at (place in the chunk), given (role or null), role (recovered), text (without the marker), opens (begins a turn); ``turns`` as ``numbered``."""
    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    keyed = turns.select("conv", "chunk", "pos", "role", "text")

    def chunk_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, KEYS):
            conv, chunk, text = (t.column(k).to_pylist() for k in ("conv", "chunk", "text"))
            made = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                lines = [x for s in text[a:b] for x in s.split("\n")]
                made.append((conv[a], chunk[a], _pack(model.matrix(symbols(lines, chunk[a] > 0)[0]))))
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], ty) for k, ty in enumerate((pa.string(), pa.int64(), pa.binary()))], [*KEYS, "matrix"])

    levels = [scratch.keep(_sorted_groups(keyed, KEYS, ["pos"], chunk_matrix, "conv string, chunk long, matrix binary"), "level-0")]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["conv", "up"]):
            conv, up, raw = (t.column(k).to_pylist() for k in ("conv", "up", "matrix"))
            made = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                total = _unpack(raw[a])
                for r in raw[a + 1 : b]:
                    total = (total[:, :, None] + _unpack(r)[None]).max(axis=1)
                made.append((conv[a], up[a], _pack(total)))
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], ty) for k, ty in enumerate((pa.string(), pa.int64(), pa.binary()))], [*KEYS, "matrix"])

    up = F.floor(F.col("chunk") / ways).cast("long").alias("up")
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) > 0:
        nxt = levels[-1].select("conv", up, "chunk", "matrix")
        levels.append(scratch.keep(_sorted_groups(nxt, ["conv", "up"], ["chunk"], combine, "conv string, chunk long, matrix binary"), f"level-{len(levels)}"))

    # Going down: ``entry`` has the scores of the states before a chunk, ``last`` the best state after it.
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entry = np.where(np.arange(STATES) == BEGIN, 0.0, -np.inf)
            best = [int((entry[:, None] + _unpack(m)).max(axis=0).argmax()) for m in b.column("matrix").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("chunk"), pa.array([_pack(entry)] * b.num_rows, pa.binary()), pa.array(best, pa.int32())], [*KEYS, "entry", "last"])

    ends = scratch.keep(levels[-1].mapInArrow(top, "conv string, chunk long, entry binary, last int"), "ends-top")

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["conv", "up"]):
            conv, chunk, raw, entry, last = (t.column(k).to_pylist() for k in ("conv", "chunk", "matrix", "entry", "last"))
            out = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                steps, score = [_unpack(r) for r in raw[a:b]], np.frombuffer(entry[a])
                states = model.path(steps, score, last[a])
                for k in range(a, b):
                    out.append((conv[k], chunk[k], _pack(score), states[k - a]))
                    score = (score[:, None] + steps[k - a]).max(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], ty) for k, ty in enumerate((pa.string(), pa.int64(), pa.binary(), pa.int32()))], [*KEYS, "entry", "last"])

    for k in range(len(levels) - 2, -1, -1):
        here = levels[k].select("conv", up, "chunk", "matrix").join(ends.withColumnRenamed("chunk", "up"), ["conv", "up"])
        ends = scratch.keep(_sorted_groups(here, ["conv", "up"], ["chunk"], down, "conv string, chunk long, entry binary, last int"), f"ends-{k}")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, KEYS):
            conv, chunk, text, role, entry, last = (t.column(k).to_pylist() for k in ("conv", "chunk", "text", "role", "entry", "last"))
            out = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = [(k, x) for k in range(a, b) for x in text[k].split("\n")]
                syms, bodies = symbols([x for _, x in own], chunk[a] > 0)
                states = model.path([model.step(s) for s in syms], np.frombuffer(entry[a]), last[a])
                for n, ((k, _), body, s) in enumerate(zip(own, bodies, states, strict=True)):
                    out.append((conv[a], chunk[a], n, role[k], ROLES[s // 2], body, s % 2 == 0))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], ty) for k, ty in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()))], [*KEYS, "at", "given", "role", "text", "opens"])

    return _sorted_groups(keyed.join(ends, KEYS), KEYS, ["pos"], lines, "conv string, chunk long, at long, given string, role string, text string, opens boolean")


def format_turns(lines: DataFrame) -> DataFrame:
    """conv, turn_no (from 0), role, n_lines, text, rendered: the recovered turns in canonical form.

    A chunk's turns are numbered within the chunk and begin where the conversation's earlier chunks end; a line before the first opening line of
    its chunk belongs to the turn before.  Text is stripped of blanks at both ends.
    """
    opened = F.sum(F.col("opens").cast("long")).over(W.partitionBy("conv", "chunk").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    chunks = lines.groupBy("conv", "chunk").agg(F.sum(F.col("opens").cast("long")).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.select("conv", "chunk", before.alias("before"))
    numbered = lines.withColumn("opened", opened).join(chunks, ["conv", "chunk"]).withColumn("turn_no", F.col("before") + F.col("opened") - 1)
    own = F.array_sort(F.collect_list(F.struct("chunk", "at", "text")))
    turns = numbered.groupBy("conv", "turn_no", "role").agg(own.alias("own"))
    text = F.btrim(F.array_join(F.transform("own", lambda x: x["text"]), "\n"), F.lit(" \t\n\r\x0b\x0c"))
    turns = turns.select("conv", "turn_no", "role", F.size("own").cast("long").alias("n_lines"), text.alias("text"))
    return turns.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), escaped(F.col("text")), F.lit(END)))


def escaped(text: Column) -> Column:
    """``text`` without the rendering's own marks: ``<|`` gets a backslash in between, and one more where it has some, so that a rendering tells its turns."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def read_rendered(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of joined renderings."""
    return [(role, re.sub(r"<\\(\\*)\|", r"<\1|", text)) for role, text in re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n?", rendered, re.S)]


def format_chat(turns: DataFrame, chunk_turns: int = CHUNK_TURNS, **options) -> DataFrame:
    """Fit the model on marked turns, recover all roles and render: the columns of ``format_turns``."""
    turns = numbered(turns, chunk_turns)
    model = Model(count(turns.withColumn("role", F.when(F.col("marked"), F.col("role")))))
    return format_turns(recover(turns, model, **options))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    out = format_chat(transcript(conversations))
    own = F.when(F.col("conv") != NO_CONV, F.col("conv")).cast(dict(conversations.dtypes)["conv_id"])
    return out.select(own.alias("conv_id"), "turn_no", "role", "n_lines", "rendered")
