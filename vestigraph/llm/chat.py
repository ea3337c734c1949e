"""Chat transcripts: roles recovered by a hidden Markov model over speaker markers and line features, then canonical turns.

States are roles; a line's observation is its marker, if any, and coarse features of its text. How a role follows another
depends on the place: where a message or a marker begins, speakers change; inside a message they hardly do. Lines lie in
one total order over the cluster, cut into blocks of a bounded number of lines and bytes, so a conversation of any size is
many blocks. A block reduces to a small matrix of best scores from each state to each, the blocks of a conversation are
chained over these matrices, and then every block is decoded between its known ends: the result is that of Viterbi over
the whole conversation. Lines of one speaker make a turn; each line carries its piece of the canonical text, so that a
turn of any length is never one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vestigraph.llm.common import remainder, share, small_batches, small_or_shuffled, written

ROLES = ("system", "user", "assistant")
#: Lines and characters of a block. Conversations are fitted on blocks of about SAMPLE_ROWS lines in all.
BLOCK_LINES, BLOCK_CHARS, SAMPLE_ROWS = 512, 1 << 20, 20_000
#: Characters that go on to Spark at once.
_SENT = 1 << 20
# Speaker names that transcripts use.
_SPEAKERS = {"system": "system sys instruction instructions context", "user": "user human customer client person q question me prompt", "assistant": "assistant ai bot agent model gpt a answer response support"}
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|?|>>\s*)?(" + "|".join(sorted((w for ws in _SPEAKERS.values() for w in ws.split()), key=len, reverse=True)) + r")(?:\*\*)?\s*(?:[:>\]]|\|?>|\*\*:?)\s*", re.I)
_ROLE_OF = {w: r for r, ws in _SPEAKERS.items() for w in ws.split()}
FEATURES = ("marker", "size", "ending")
#: Where a line stands: at the beginning of its conversation, of a message or at a marker, or inside a message.
FIRST, FRESH, INSIDE = 0, 1, 2
#: How often the speaker that a marker names is the one who speaks, and how often another is; the rest of lines bear none. Transcripts with roles seldom have markers, so this is stated and not learned.
MARKED_RIGHT, MARKED_WRONG = 0.5, 0.0005
#: Lines that each count begins with, and the least share of a move: tables in which assistants never speak first don't make it impossible.
PRIOR, LEAST_MOVE = 0.5, 0.002


def marker_of(text: str) -> str | None:
    m = _MARKER.match(text)
    return _ROLE_OF[m.group(1).lower()] if m else None


def observe(text: str) -> tuple[str, ...]:
    """Discrete observation of a line."""
    end = text.rstrip()[-1:]
    return (marker_of(text) or "none", str(min(12, len(text).bit_length())), end if end in (".", "?", "!", ":", "") else "x")


def split_marker(text: str, role: str) -> tuple[str, str]:
    """The marker and the rest, if the marker names that role; a leading word that names another one is part of what was said."""
    m = _MARKER.match(text)
    return (m.group(), text[m.end() :]) if m and _ROLE_OF[m.group(1).lower()] == role else ("", text)


def escaped(text: str) -> str:
    """No content can look like the marks of a turn. unescaped() gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


class Model:
    """Log probabilities from counted, smoothed training lines. moves: (kind, role before or '', role) -> lines; seen: (role, feature, value) -> lines."""

    def __init__(self, moves: dict[tuple[int, str, str], float], seen: dict[tuple[str, int, str], float]):
        table = np.array([[[moves.get((kind, a if kind else "", b), 0.0) + PRIOR for b in ROLES] for a in ROLES] for kind in (FIRST, FRESH, INSIDE)])
        # Inside a message the speaker stays unless training lines show otherwise.
        table[INSIDE] += np.eye(len(ROLES)) * 1000 * PRIOR
        table = table / table.sum(2, keepdims=True)
        table[:INSIDE] += LEAST_MOVE
        self.moves = np.log(table / table.sum(2, keepdims=True))
        self.seen: dict[tuple[int, str], np.ndarray] = {}
        values = {(f, v) for _, f, v in seen if f}
        for f in range(1, len(FEATURES)):
            own = [v for g, v in values if g == f]
            total = np.array([sum(seen.get((r, f, v), 0.0) for v in own) for r in ROLES])
            for v in own:
                self.seen[f, v] = np.log((np.array([seen.get((r, f, v), 0.0) for r in ROLES]) + PRIOR) / (total + PRIOR * (len(own) + 1)))
        for i, r in enumerate(ROLES):
            self.seen[0, r] = np.log([MARKED_RIGHT if j == i else MARKED_WRONG for j in range(len(ROLES))])
        self.none = np.zeros(len(ROLES))
        self.known: dict[tuple, np.ndarray] = {}  # observations are few, so each one's matrix is made once

    def step(self, seen: tuple[str, ...], kind: int) -> np.ndarray:
        """Best-score matrix of one line from each state before it; before the first line all states count as one."""
        if (found := self.known.get((seen, kind))) is None:
            emit = sum((self.seen.get((f, v), self.none) for f, v in enumerate(seen)), self.none)
            found = self.known[seen, kind] = self.moves[kind] + emit[None, :]
        return found

    def steps(self, texts: list[str], heads: list[bool], opens: bool) -> list[np.ndarray]:
        seen = [observe(t) for t in texts]
        return [self.step(s, k) for s, k in zip(seen, kinds_of(seen, heads, opens), strict=True)]


def kinds_of(seen: list[tuple[str, ...]], heads: list[bool], opens: bool) -> list[int]:
    return [FIRST if opens and i == 0 else FRESH if head or s[0] != "none" else INSIDE for i, (s, head) in enumerate(zip(seen, heads, strict=True))]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def decode(steps: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """The best states of a block between the state before it and its last state; of equal ones the first role."""
    best, back = steps[0][entry], []
    for s in steps[1:]:
        reach = best[:, None] + s
        back.append(reach.argmax(0))
        best = reach.max(0)
    out = [leave]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


BLOCK = "conv_id long, block long, turns array<long>, heads array<boolean>, lines array<int>, texts array<string>, roles array<string>"


def blocks_of(messages: DataFrame, block_lines: int = BLOCK_LINES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Messages (conv_id, turn, text, role) as blocks of lines, a written table.

    Messages are dealt by ranges of conversation, turn and text, so no conversation has to fit one task. A message is cut
    at line ends; blank lines go, but a message without any other keeps an empty one. Null text is empty, a null turn
    comes first, and all rows without a conv_id are one conversation. role is carried along for fitting only.
    """
    small_batches(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("role").cast("string"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "text", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        conv: object = ()
        held: list[tuple] = []
        chars = 0

        done: list[dict] = []
        size = 0

        def close() -> None:
            nonlocal number, held, chars, size
            turns, heads, lines, texts, roles = zip(*held, strict=True)
            done.append({"conv_id": conv, "block": number, "turns": turns, "heads": heads, "lines": lines, "texts": texts, "roles": roles})
            size += chars + len(held)
            number, held, chars = number + 1, [], 0

        for b in batches:
            for conv_id, turn, text, role, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and conv_id != conv:
                    close()
                conv = conv_id
                for nth, line in enumerate([x for x in text.split("\n") if x.strip()] or [""]):
                    held.append((turn, nth == 0, nth, line, role))
                    chars += len(line)
                    if len(held) >= block_lines or chars >= block_chars:
                        close()
                if size >= _SENT:  # many small blocks go on together
                    yield pa.RecordBatch.from_pylist(done, schema=_BLOCK)
                    done, size = [], 0
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_BLOCK)

    return written(dealt.mapInArrow(cut, BLOCK), "chat-blocks")


_BLOCK = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("turns", pa.list_(pa.int64())), ("heads", pa.list_(pa.bool_())), ("lines", pa.list_(pa.int32())), ("texts", pa.list_(pa.string())), ("roles", pa.list_(pa.string()))])


def fit(blocks: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Counts moves and observations over blocks of about sample_rows lines; only lines whose role is known count. Blocks, not conversations, are sampled, so a very long conversation can't exceed the bound. Counts alone reach the driver, some dozens of rows."""
    n = blocks.agg(F.sum(F.size("texts"))).first()[0] or 0
    known = blocks.where(share(min(1.0, sample_rows / max(n, 1)), "conv_id", F.element_at("turns", 1), F.element_at("texts", 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, int] = {}
        for b in batches:
            for row in b.to_pylist():
                before = ""
                opens = row["turns"][0] in (0, None)
                seen = [observe(x) for x in row["texts"]]
                for values, role, kind in zip(seen, row["roles"], kinds_of(seen, row["heads"], opens), strict=True):
                    if role in ROLES:
                        if kind == FIRST or before:
                            k = ("", -1 - kind, role if kind == FIRST else f"{before}>{role}")
                            n[k] = n.get(k, 0) + 1
                        for f, v in enumerate(values):
                            n[role, f, v] = n.get((role, f, v), 0) + 1
                    before = role if role in ROLES else ""
        cols = list(zip(*((*k, v) for k, v in n.items()), strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["role", "f", "v", "n"])

    total = known.mapInArrow(count, "role string, f int, v string, n long").groupBy("role", "f", "v").agg(F.sum("n").alias("n")).collect()
    moves = {(-1 - r["f"], *(("", r["v"]) if r["f"] == -1 else r["v"].split(">"))): float(r["n"]) for r in total if r["f"] < 0}
    return Model(moves, {(r["role"], r["f"], r["v"]): float(r["n"]) for r in total if r["f"] >= 0})


TURNS = "conv_id long, turn long, line int, role_pred string, marker string, content string, opens boolean, nth long, block long, piece string"


def recover(blocks: DataFrame, model: Model) -> DataFrame:
    """For each line of the blocks: conv_id, turn, line, role_pred, turn_nr (from 0, a turn is all lines of one role in a row), marker, content and rendered, its piece of the canonical text. An empty table gives no rows."""
    spark = blocks.sparkSession
    held = spark.sparkContext.broadcast(model)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                first, *rest = held.value.steps(row["texts"], row["heads"], False)
                total = None
                for s in rest:
                    total = s if total is None else _times(total, s)
                opening = held.value.steps(row["texts"][:1], row["heads"][:1], True)[0]
                best = [(s if total is None else _times(s, total)).ravel().tolist() for s in (first, opening)]
                out.append((row["conv_id"], row["block"], *best))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.list_(pa.float64())) for c in cols[2:])], names=["conv_id", "block", "inner", "first"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(ROLES)
        every = (r for b in batches for r in b.to_pylist())
        out: list[tuple] = []

        def ends_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()), strict=True)], names=["conv_id", "b", "entry", "leave", "opens", "closes"])

        for _, own in groupby(every, lambda r: r["conv_id"]):
            score, back, numbers, conv = np.zeros(k), [], [], None
            score[1:] = -np.inf
            for r in own:
                conv = r["conv_id"]
                reach = score[:, None] + np.array(r["inner" if back else "first"]).reshape(k, k)
                back.append(reach.argmax(0).astype(np.int8))
                numbers.append(r["block"])
                score = reach.max(0)
            state = int(score.argmax())
            for i in range(len(back) - 1, -1, -1):
                entry = int(back[i][state])
                out.append((conv, numbers[i], entry, state, i == 0, i == len(back) - 1))
                state = entry
            if len(out) >= 4096:
                yield ends_of(out)
                out = []
        yield ends_of(out)

    reduced = blocks.select("conv_id", "block", "texts", "heads").mapInArrow(reduce, "conv_id long, block long, inner array<double>, first array<double>")
    ends = reduced.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(chain, "conv_id long, b long, entry int, leave int, opens boolean, closes boolean")
    ends = written(ends.drop("conv_id"), "chat-ends")
    joined = blocks.drop("roles").join(small_or_shuffled(ends, 64), F.col("block") == F.col("b"))

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        names = [c.split()[0] for c in TURNS.split(", ")]
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for row in b.to_pylist():
                states = decode(held.value.steps(row["texts"], row["heads"], row["opens"]), row["entry"], row["leave"])
                before, nth = -1 if row["opens"] else row["entry"], 0
                for i, (state, text) in enumerate(zip(states, row["texts"], strict=True)):
                    role, starts = ROLES[state], state != before
                    nth += starts
                    marker, content = split_marker(text, role)
                    piece = ("" if before < 0 else "<|end|>\n" if starts else "\n") + (f"<|{role}|>\n" if starts else "") + escaped(content)
                    if row["closes"] and i == len(states) - 1:
                        piece += "<|end|>\n"
                    rows.append((row["conv_id"], row["turns"][i], row["lines"][i], role, marker, content, starts, nth, row["block"], piece))
                    before = state
                    size += len(piece)
                if len(rows) >= 4096 or size >= _SENT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
        cols = list(zip(*rows, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    lines = written(joined.mapInArrow(turns, TURNS), "chat-lines")
    sums = lines.groupBy("conv_id", "block").agg(F.count_if("opens").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("block").alias("b"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - 1).alias("base"))
    rows = lines.join(small_or_shuffled(written(base, "chat-bases"), 32), F.col("block") == F.col("b"))
    return rows.select("conv_id", "turn", "line", "role_pred", (F.col("base") + F.col("nth")).alias("turn_nr"), "marker", "content", F.col("piece").alias("rendered"), "block")


def parse(conversations: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Every line of a conversation table, whose rows may hold whole transcripts: its speaker, its turn and its piece of the canonical text.

    Pieces in order of conv_id, turn and line (within a message as it stood) are the canonical transcript. Roles are learned
    from conversations that aren't held out and are never read for prediction. Rows that repeat all stay. Null texts are empty, an empty table gives no rows, columns
    but conv_id, turn, text and role are not read.
    """
    rows = conversations.select("conv_id", "turn", "text", "role")
    blocks = blocks_of(rows)
    model = fit(blocks.where(remainder("conv_id", folds) != held_out), sample_rows)
    return recover(blocks, model).drop("block").withColumn("held_out", remainder("conv_id", folds) == held_out)


def transcripts(texts: DataFrame, model: Model, id_column: str, text_column: str) -> DataFrame:
    """Raw transcripts, one text each, by a fitted model: as recover()."""
    rows = texts.select(F.col(id_column).alias("conv_id"), F.lit(0).alias("turn"), F.col(text_column).alias("text"), F.lit(None).cast("string").alias("role"))
    return recover(blocks_of(rows), model).drop("block")
