import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.llm import chat
from cinderlake.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, conv string, chunk int"


def plain_line(line, after_blank):
    """(symbol, body) of a line, read letter by letter."""
    i, n = 0, len(line)

    def skip(chars):
        nonlocal i
        start = i
        while i < n and (line[i].isspace() if chars is None else line[i] in chars):
            i += 1
        return i > start

    role = None
    skip(None)
    if skip("#>*[(<|"):
        skip(None)
    name = next((x for x in sorted(chat.NAMES, key=len, reverse=True) if line[i : i + len(x)].lower() == x), None)
    if name:
        i += len(name)
        skip(None)
        closed = skip("])>*|")
        at = i
        if closed:
            skip(None)
            i = i + 1 if line[i : i + 1] == ":" else at
        if closed or line[i : i + 1] in (":", "-") and line[i : i + 1]:
            i += 0 if closed else 1
            skip(None)
            role = chat.NAMES[name]
    body = line[i:] if role else line
    length = 0 if not body else 1 if len(body) < 60 else 2 if len(body) < 240 else 3
    mark = 1 + chat.ROLES.index(role) if role else 0
    return mark * 16 + length * 4 + 2 * body.rstrip().endswith("?") + after_blank, body


def brute(turns, model):
    """One Viterbi pass over each whole conversation: [(conv, role, text)] of its turns."""
    by = {}
    for r in turns:
        by.setdefault(r.conv_id, []).append((r.turn, r.role is not None, r.role or "", r.mark, r.text))
    out = []
    states = range(chat.STATES)
    for conv, rows in by.items():
        lines = [x for t in sorted(rows) for x in t[4].split("\n")]
        read = [plain_line(x, bool(k) and not lines[k - 1].strip()) for k, x in enumerate(lines)]
        score, back = [0.0 if s == chat.BEGIN else -math.inf for s in states], []
        for sym, _ in read:
            ways = [[score[a] + (model.move[a, b] + model.say[b, sym]) for a in states] for b in states]
            back.append([max(states, key=lambda a, w=w: w[a]) for w in ways])
            score = [max(w) for w in ways]
        state, path = max(states, key=lambda s: score[s]), []
        for b in reversed(back):
            path.append(state)
            state = b[state]
        n, made = -1, []
        for s, (_, body) in zip(path[::-1], read, strict=True):
            if s % 2 == 0:
                n += 1
                made.append([conv, n, chat.ROLES[s // 2], []])
            made[-1][3].append(body)
        out += [(c, k, r, "\n".join(x).strip(" \t\n\r\x0b\x0c")) for c, k, r, x in made]
    return sorted(out, key=str)


def got(df):
    return sorted(((None if r.conv == "\0null" else int(r.conv), r.turn_no, r.role, r.text) for r in df.collect()), key=str)


def marked_only(turns):
    return turns.withColumn("role", F.when(F.col("marked"), F.col("role")))


def test_roles_are_recovered(spark):
    conv = table(spark, SF, "conversations")
    turns = chat.numbered(chat.transcript(conv)).cache()
    model = chat.Model(chat.count(marked_only(turns)))
    # the given role is only carried along: it says here whether the turn has kept its marker
    told = turns.withColumn("role", F.concat(F.when(F.col("marked"), "kept ").otherwise("lost "), "role"))
    lines = [(r.given.split(), r.role) for r in chat.recover(told, model).collect() if r.given]
    kept, lost = ([role == g[1] for g, role in lines if g[0] == kind] for kind in ("kept", "lost"))
    print(f"lines with a marker: {np.mean(kept):.4f} of {len(kept)}, without: {np.mean(lost):.4f} of {len(lost)}")
    assert np.mean(kept) > 0.999 and np.mean(lost) > 0.92 and len(lost) > 300
    assert chat.format_turns(chat.recover(turns, model)).count() == pytest.approx(conv.count(), rel=0.05)


@pytest.mark.parametrize("chunk_turns,ways", [(1, 2), (3, 2), (64, 256)])
def test_chunks_give_the_result_of_one_pass(spark, chunk_turns, ways):
    rng = random.Random(4)
    rows = []
    for conv in [1, 2, 3, None]:
        for turn in range(rng.randrange(1, 40) if conv != 2 else 150):
            role = rng.choice(["user", "Assistant", "human", None, "tool"]) if turn else "system"
            rows.append((conv, turn, role, "\n".join(rng.choice(["", "words " * rng.randrange(90), "really?", "User: quoted"]) for _ in range(rng.randrange(1, 4))), "x", 0))
    rows += [(1, 2, "user", None, "x", 0), (1, None, "user", "no turn", "x", 0), (3, 1, "user", "twice", "x", 0), (3, 1, "user", "twice", "x", 0)]
    turns = chat.transcript(spark.createDataFrame(rows, SCHEMA)).cache()
    ordered = chat.numbered(turns, chunk_turns)
    model = chat.Model(chat.count(ordered))
    assert got(chat.format_turns(chat.recover(ordered, model, ways))) == brute(turns.withColumn("mark", F.xxhash64("text")).collect(), model)


def test_counts_do_not_depend_on_chunks(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, None]), rng.choice([k, None, 5]), rng.choice(["user", "bot", None]), f"text {k}\nmore" * (k % 3), "x", 0) for k in range(200)]
    turns = chat.transcript(spark.createDataFrame(rows, SCHEMA)).cache()
    assert chat.count(chat.numbered(turns, 1)) == chat.count(chat.numbered(turns, 7)) == chat.count(chat.numbered(turns, 1000))


def test_turns_of_one_number_are_cut_into_chunks(spark):
    """A third of all rows without a conversation or a turn number, and one very long turn."""
    rows = [(None, None, "user", f"line {k}", "x", 0) for k in range(500)] + [(7, 3, "assistant", f"again {k}", "x", 0) for k in range(300)] + [(8, 0, "user", "long line\n" * 20_000, "x", 0)]
    turns = chat.numbered(chat.transcript(spark.createDataFrame(rows, SCHEMA)), 16)
    sizes = [r["count"] for r in turns.groupBy("conv", "chunk").count().collect()]
    assert sum(sizes) == 801 and max(sizes) <= 16
    assert turns.groupBy("conv").agg(F.max("chunk") + 1 == F.count_distinct("chunk")).collect()[0][1]
    formatted = chat.format_chat(chat.transcript(spark.createDataFrame(rows, SCHEMA)))
    assert formatted.agg(F.sum("n_lines")).first()[0] == 500 * 2 + 300 * 2 + 20_002


def test_markers():
    for line, role in [("User: hi", "user"), ("### Assistant: hi", "assistant"), ("[bot] hi", "assistant"), ("<|system|> hi", "system"), ("Human - hi", "user"), ("users: hi", None), ("A: hi", "assistant"), ("A cat", None)]:
        symbol, body = chat.read_line(line, False)
        mark = symbol // (chat.LENGTHS * 4)
        assert (chat.ROLES[mark - 1] if mark else None) == role, line
        assert body == ("hi" if role else line)


def test_empty(spark):
    assert chat.format_chat(chat.transcript(spark.createDataFrame([], SCHEMA))).count() == 0


def test_ids_keep_their_type(spark, tmp_path):
    rows = [("x-1", 0, "user", "hi there", "a", 0), ("x-1", 1, "assistant", "yes", "a", 0), (None, 0, "user", "who", "a", 0), ("12", 0, "user", "what", "a", 0)]
    spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string")).write.parquet(str(tmp_path / "conversations.parquet"))
    out = chat.op2_chat_format(spark, str(tmp_path))
    assert dict(out.dtypes)["conv_id"] == "string" and {r.conv_id for r in out.collect()} == {"x-1", "12", None}
    assert dict(chat.op2_chat_format(spark, SF).dtypes)["conv_id"] == dict(table(spark, SF, "conversations").dtypes)["conv_id"]


def test_a_rendering_tells_its_turns(spark):
    texts = ["plain", "<|end|>", "a <|user|>\nb", "<\\|end|>", "<\\\\|x", "line\n<|end|>\n<|assistant|>\nline", "", "< |"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.concat(F.lit("<|user|>\n"), chat.escaped(F.col("t")), F.lit(chat.END)).alias("r")).collect()
    assert [chat.read_rendered(r.r) for r in got] == [[("user", r.t)] for r in got]
    joined = "\n".join(r.r for r in got)
    assert [t for _, t in chat.read_rendered(joined)] == texts
