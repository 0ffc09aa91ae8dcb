"""Transcript parsing: a hidden Markov model recovers speakers, then turns are rendered in one form.

A transcript is a sequence of lines. Hidden states are (role, first line of a turn or not); what is seen of a line is its
speaker marker, whether a blank line stands before it, a class of its length, and whether it ends in a question mark. The model is
counted, with one added to each count, on the labelled conversations, and Viterbi gives the most likely states.
Markers go, and each turn becomes ``<|role|>`` , its lines, ``<|end|>``.

A conversation of any length is cut into parts of ``PART`` turns, counted after its turns are put in order. Each part gives the best log
probability from every state before it to every state at its end (a small matrix), the parts' matrices of a conversation are joined
by Viterbi, and each part is then decoded between its two states. A part knows whether a blank line stands before it, and how many
blank lines of an open turn the parts before it hold back. So the result is that of one pass over the whole conversation (where
several state sequences are equally likely, it is one of those), but no task holds more than a part and, for each conversation, a
few numbers a part. Model counts are summed in each task before the shuffle.

Blank lines at the start and end of a turn's text go at its end mark, those inside it stay. The rendered parts of a conversation, the
empty ones left out, joined by newlines are its rendering.

Null texts are empty and give one empty line. Null roles and roles other than those named count as ``other``; null turns come first, and null
conversations are one conversation. Equal (conversation, turn) rows follow each other by role and text. An empty table gives no rows.
Only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlens.functions import ordered
from guardlens.session import cut

ROLES = ("system", "user", "assistant", "other")
STATES = 2 * len(ROLES)  # role * 2 + (1 inside a turn, 0 at its first line)
PART = 256
#: fixed values: speaker markers of common transcript styles; an empty one is a turn without a marker
MARKERS = {
    "system": ("System: ", "### System: ", "[system] ", ""),
    "user": ("User: ", "Human: ", "Q: ", ""),
    "assistant": ("Assistant: ", "AI: ", "A: ", ""),
    "other": ("Other: ", "Tool: ", "", ""),
}
_FORMS = [(r, m) for r, ms in MARKERS.items() for m in ms if m]
_MARKER = re.compile("|".join(re.escape(m) for _, m in sorted(_FORMS, key=lambda x: -len(x[1]))))
_ROLE_OF = {m: ROLES.index(r) for r, m in _FORMS}
LENGTHS = (0, 3, 8, 15, 30)
SYMBOLS = (len(ROLES) + 1) * 2 * (len(LENGTHS) + 1) * 2


def symbol(line: str, blank_before: bool) -> tuple[int, str]:
    """What the model sees of a line, and the line without its marker."""
    m = _MARKER.match(line)
    who = _ROLE_OF[m[0]] if m else len(ROLES)
    rest = line[m.end():] if m else line
    n = sum(len(rest.split()) > x for x in LENGTHS)
    return ((who * 2 + blank_before) * (len(LENGTHS) + 1) + n) * 2 + rest.rstrip().endswith("?"), rest


def transcripts(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                part: int = PART) -> DataFrame:
    """(conv, part, lines, truth): transcript lines with markers, and the true state of each line.

    The marker of a turn is chosen by a hash of conversation and turn among the styles of its role (one in four turns has
    none); blank lines stand between turns in every other conversation.
    """
    c = conversations.select(F.col(conv).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("turn"),
                             F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = ordered.with_ordinal(c, ordered.Order(("conv",), "turn", ("role", "text"), part), "ordinal")
    style = F.pmod(F.xxhash64("conv", "turn"), F.lit(4)).cast("int")
    row = F.struct("ordinal", "role", "text", style.alias("style"))
    rows = (numbered.groupBy("conv", F.floor((F.col("ordinal") - 1) / part).alias("part")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
            .withColumn("spaced", F.pmod(F.xxhash64("conv"), F.lit(2)) == 0))
    # a blank line follows every turn of a spaced conversation but the last one
    last = _narrow(numbered.groupBy("conv").agg(F.max("ordinal").alias("ordinals")))
    rows = (rows.join(last, F.col("conv").eqNullSafe(F.col("__conv")), "left")
            .withColumn("ends", F.floor((F.col("ordinals") - 1) / part) == F.col("part")).select("conv", "part", "turns", "spaced", "ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, truth = [], []
            for turns, spaced, ends in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                out, states = [], []
                for t in turns:
                    r = t["role"] if t["role"] in ROLES else "other"
                    for k, line in enumerate(t["text"].split("\n")):
                        out.append(line if k else MARKERS[r][t["style"]] + line)
                        states.append(2 * ROLES.index(r) + (k > 0))
                    if spaced and not (ends and t is turns[-1]):
                        out.append("")
                        states.append(states[-1] | 1)
                lines.append(out)
                truth.append(bytes(states))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.list_(pa.string())), pa.array(truth, pa.binary())],
                                             names=["conv", "part", "lines", "truth"])

    kind = conversations.schema[conv].dataType.simpleString()
    return rows.mapInArrow(run, f"conv {kind}, part long, lines array<string>, truth binary")


def _narrow(few: DataFrame) -> DataFrame:
    """Key columns renamed, for a join that lets null conversations meet."""
    return few.select(*[F.col(c).alias(f"__{c}" if c in ("conv", "part") else c) for c in few.columns])


def with_borders(scripts: DataFrame) -> DataFrame:
    """Adds what a part has before it: ``blank`` (a blank line, or the start), the true state ``before`` (-1 at the start), and whether
    it is the ``last`` part. Windows run over two values a part, not over the lines."""
    w = Window.partitionBy("conv").orderBy("part")
    end = scripts.select("conv", "part", (F.trim(F.regexp_replace(F.element_at("lines", -1), r"[\s\x1c-\x1f\x85]", "")) == "").alias("b"),
                         F.conv(F.hex(F.substring("truth", -1, 1)), 16, 10).cast("int").alias("t"))
    few = _narrow(end.select("conv", "part", F.coalesce(F.lag("b").over(w), F.lit(True)).alias("blank"), F.coalesce(F.lag("t").over(w), F.lit(-1)).alias("before"),
                             F.lead("t").over(w).isNull().alias("last")))
    return scripts.join(few, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part"))).drop("__conv", "__part")


def symbols_of(lines: list[str], blank: bool = True) -> list[int]:
    out = []
    for line in lines:
        out.append(symbol(line, blank)[0])
        blank = not line.strip()
    return out


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities (start, moves, emissions) from rows of ``with_borders``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, seen = np.zeros((STATES + 1, STATES), np.int64), np.zeros((STATES, SYMBOLS), np.int64)
        for batch in batches:
            for lines, truth, before, blank in zip(*[batch.column(k).to_pylist() for k in ("lines", "truth", "before", "blank")]):
                s = np.frombuffer(truth, np.uint8).astype(np.int64)
                np.add.at(moves, (np.append(STATES if before < 0 else before, s[:-1]), s), 1)
                np.add.at(seen, (s, symbols_of(lines, blank)), 1)
        a, b = np.concatenate([moves.ravel(), seen.ravel()]), None
        b = np.flatnonzero(a)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(a[b], pa.int64())], names=["k", "n"])

    counts = np.ones((STATES + 1) * STATES + STATES * SYMBOLS)
    sums = labelled.select("lines", "truth", "before", "blank").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # at most one row for each parameter of the model
        counts[r["k"]] += r["n"]
    moves = counts[:(STATES + 1) * STATES].reshape(STATES + 1, STATES)
    seen = counts[(STATES + 1) * STATES:].reshape(STATES, SYMBOLS)
    moves, seen = np.log(moves / moves.sum(axis=1, keepdims=True)), np.log(seen / seen.sum(axis=1, keepdims=True))
    return moves[-1], moves[:-1], seen


def span(model, obs: list[int], first: bool) -> np.ndarray:
    """Best log probability of the lines from each state before them (row) to each state at their end (column)."""
    start, moves, seen = model
    best = np.tile(start + seen[:, obs[0]], (STATES, 1)) if first else moves + seen[:, obs[0]]
    for o in obs[1:]:
        best = (best[:, :, None] + moves[None]).max(axis=1) + seen[:, o]
    return best


def decode(model, obs: list[int], before: int, last: int) -> np.ndarray:
    """States of the lines, between the state before them (-1: the start) and the given last one (-1: any)."""
    start, moves, seen = model
    best = (start if before < 0 else moves[before]) + seen[:, obs[0]]
    back = np.zeros((len(obs), STATES), np.int64)
    for k, o in enumerate(obs[1:], 1):
        through = best[:, None] + moves
        back[k] = through.argmax(axis=0)
        best = through.max(axis=0) + seen[:, o]
    out = np.zeros(len(obs), np.int64)
    out[-1] = best.argmax() if last < 0 else last
    for k in range(len(obs) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def render(lines: list[str], states: np.ndarray, before: int, held: int, last: bool) -> tuple[str, int, str]:
    """Canonical text, turns begun in these lines, and their roles by initial. A turn that goes on has no opening mark here.

    ``held`` blank lines stand before these lines in a turn that may go on; they come out once a line with text follows in it.
    """
    out, roles, role = [], "", -1 if before < 0 else before // 2
    for line, s in zip(lines, states.tolist()):
        if s % 2 == 0 or s // 2 != role:
            if role >= 0:
                out.append("<|end|>")
            role, held = s // 2, 0
            out.append(f"<|{ROLES[role]}|>")
            roles += ROLES[role][0]
        rest = symbol(line, False)[1]
        if not rest.strip():
            held += 1
        else:
            out += [""] * held + [rest]
            held = 0
    if last and role >= 0:
        out.append("<|end|>")
    return "\n".join(out), len(roles), roles


def blanks(lines: list[str], states: np.ndarray, before: int) -> tuple[int, bool]:
    """Blank lines held back at the end, and whether these are all the lines, in the turn that was open before them."""
    held, role = 0, -1 if before < 0 else before // 2
    goes_on = True
    for line, s in zip(lines, states.tolist()):
        if s % 2 == 0 or s // 2 != role:
            role, held, goes_on = s // 2, 0, False
        if symbol(line, False)[1].strip():
            held, goes_on = 0, False
        else:
            held += 1
    return held, goes_on


def _chained(rows: DataFrame, columns: list[str], many: DataFrame, each, out: str) -> DataFrame:
    """Runs ``each`` over the small structs of all parts of a conversation, in order; it gives a tuple for each part."""
    kind = rows.schema["conv"].dataType.simpleString()
    names = [c.split()[0] for c in out.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple] = []
            convs: list = []
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p, values in zip(parts, each(parts)):
                    convs.append(conv)
                    got.append((p["part"], *values))
            cols = list(zip(*got)) or [[]] * (1 + len(names))
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.column(0).type), pa.array(cols[0], pa.int64()),
                                              *[pa.array(c, types[d.split()[1]]) for c, d in zip(cols[1:], out.split(", "))]], names=["conv", "part", *names])

    small = rows.join(many, F.col("conv").eqNullSafe(F.col("__conv")), "left_semi")
    return _narrow(small.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", *columns))).alias("parts"))
                   .mapInArrow(run, f"conv {kind}, part long, {out}"))


def _joined(parts: list[dict]) -> list[tuple[int, int]]:
    """(state before, last state) of each part by Viterbi over the parts' matrices."""
    best, backs = None, []
    for x in parts:
        m = np.array(x["m"]).reshape(STATES, STATES)
        through = m if best is None else best[:, None] + m
        backs.append(through.argmax(axis=0))
        best = through.max(axis=0)
    last, out = int(best.argmax()), []
    for k in range(len(parts) - 1, -1, -1):
        before = int(backs[k][last]) if k else -1
        out.append((before, last))
        last = before
    return out[::-1]


def _held(parts: list[dict]) -> list[tuple[int]]:
    """Blank lines that the parts before hold back, for each part."""
    out, held = [], 0
    for x in parts:
        out.append((held,))
        held = x["held"] + (held if x["goes_on"] else 0)
    return out


def parse(scripts: DataFrame, model) -> DataFrame:
    """(conv, part, n_lines, n_turns, roles, rendered, states) for each part of each transcript."""
    shared = scripts.sparkSession.sparkContext.broadcast(model)
    kind = scripts.schema["conv"].dataType.simpleString()
    rows = cut(with_borders(scripts).select("conv", "part", "lines", "blank", "last"), "parts")
    many = _narrow(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("conv"))
    same = F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [span(shared.value, symbols_of(x, b), k == 0).ravel().tolist() for k, x, b in zip(*(batch.column(c).to_pylist() for c in ("part", "lines", "blank")))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m, pa.list_(pa.float64()))], names=["conv", "part", "m"])

    # one small matrix for each part of a conversation that has several
    several = rows.join(many, F.col("conv").eqNullSafe(F.col("__conv")), "left_semi")
    ends = _chained(several.select("conv", "part", "lines", "blank").mapInArrow(matrices, f"conv {kind}, part long, m array<double>"), ["m"], many, _joined, "before int, end int")
    bounded = rows.join(ends, same, "left").select("conv", "part", "lines", "blank", "last", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("end", F.lit(-1)).alias("end"))

    def states_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lines, blank, before, end in zip(*[batch.column(k).to_pylist() for k in ("lines", "blank", "before", "end")]):
                s = decode(shared.value, symbols_of(lines, blank), before, end)
                out.append((bytes(s.tolist()), *blanks(lines, s, before)))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("conv", "part", "lines", "last", "before")],
                                              *[pa.array(x, k) for x, k in zip(cols, (pa.binary(), pa.int32(), pa.bool_()))]], names=["conv", "part", "lines", "last", "before", "states", "held", "goes_on"])

    decoded = cut(bounded.mapInArrow(states_of, f"conv {kind}, part long, lines array<string>, last boolean, before int, states binary, held int, goes_on boolean"), "decoded")
    waiting = _chained(decoded, ["held", "goes_on"], many, _held, "waiting int")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lines, states, before, held, last in zip(*[batch.column(k).to_pylist() for k in ("lines", "states", "before", "waiting", "last")]):
                text, n, roles = render(lines, np.frombuffer(states, np.uint8), before, held, last)
                out.append((len(lines), n, roles, text))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), *[pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                              batch.column("states")], names=["conv", "part", "n_lines", "n_turns", "roles", "rendered", "states"])

    final = decoded.join(waiting, same, "left").select("conv", "part", "lines", "states", "before", F.coalesce("waiting", F.lit(0)).alias("waiting"), "last")
    return final.mapInArrow(finish, f"conv {kind}, part long, n_lines long, n_turns long, roles string, rendered string, states binary")


def in_training(conv: Column) -> Column:
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def recover(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    """Transcripts of all conversations, parsed by a model of those in training, with the lines whose role is right."""
    scripts = cut(transcripts(conversations, conv, turn, role, text, part), "transcripts")
    model = fit(with_borders(scripts).where(in_training(F.col("conv"))))
    parsed = parse(scripts, model)
    both = parsed.join(scripts.select(F.col("conv").alias("c"), F.col("part").alias("p"), "truth"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int((np.frombuffer(a, np.uint8) // 2 == np.frombuffer(b, np.uint8) // 2).sum()) for a, b in zip(batch.column("states").to_pylist(), batch.column("truth").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("conv", "part", "n_lines", "n_turns", "roles", "rendered")], pa.array(n, pa.int64())],
                                             names=[conv, "part", "n_lines", "n_turns", "roles", "rendered", "lines_right"])

    kind = conversations.schema[conv].dataType.simpleString()
    out = both.mapInArrow(right, f"`{conv}` {kind}, part long, n_lines long, n_turns long, roles string, rendered string, lines_right long")
    return out.withColumn("held_out", ~in_training(F.col(conv)))
