"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns by turns, the last by the assistant. For
each input turn the automaton's states (nothing yet, or the role of the last turn put out) allow: keep the turn; relabel
it; merge it into the last turn; put an empty turn before it, and keep or relabel it. Dynamic programming takes the
cheapest sequence; ties go to the option listed first. The repaired turns are rendered with role tags.

A text's own "<|" is written "<\\|" (and "<\\|" as "<\\\\|", and so on), so that no text can end its turn or begin another;
``unescaped`` takes that back.

A conversation is processed in chunks of ``CHUNK`` turn numbers, so that the longest one is spread over tasks. Pass 1
reduces a chunk to a 4 x 4 matrix of least costs between states; pass 2 combines the matrices of a conversation, a row a
chunk; pass 3 repairs each chunk between the states so settled. A turn that merges over a chunk's edge still renders
right, because a tag is closed by what opens the next one.

Output: a row a piece (an input turn or an empty one put in): conv_id, seq (number of the repaired turn it belongs to),
turn (null for empty ones), role, action, rendered. Pieces ordered by (seq, turn) and joined are the rendered text; an
empty turn is its own seq.

Defined cases: null texts are empty, a very long text is one piece; null and unknown roles cost a relabelling; turns of one
number follow by role and text, and repeated rows each stay; null turns come last, in ``NULL_CHUNKS`` chunks by a hash of role
and text (rows that agree in conversation, turn number, role and text are one task's); null conversation ids are one
conversation; an empty table gives no rows; other columns, whatever their names, are ignored. Between repairs of one cost
the chunks' edges have a say, so another ``CHUNK`` may give another of the cheapest ones.
"""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, written

CHUNK = 1024  # a power of two
NULL_CHUNKS = 256
#: The first of the chunks of null turns; no turn number's chunk is as large.
_LATE = 1 << 60
ROLES = ("", "system", "user", "assistant")
#: Fixed names that other corpora give the roles.
ALIASES = {"system": 1, "developer": 1, "user": 2, "human": 2, "prompter": 2, "assistant": 3, "bot": 3, "gpt": 3, "model": 3}
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
RELABEL, MERGE, INSERT, END_INSERT = 3, 1, 2, 2
_FAR = 1 << 40


def _steps(role: int) -> list[list[tuple[int, int, str, int] | None]]:
    """[state][state after]: (cost, turns put out, action, role of the empty turn or 0), the cheapest way."""
    best: list[list] = [[None] * 4 for _ in range(4)]

    def offer(s: int, e: int, cost: int, outs: int, action: str, empty: int = 0) -> None:
        if best[s][e] is None or cost < best[s][e][0]:
            best[s][e] = (cost, outs, action, empty)

    label = lambda to: 0 if role == to else RELABEL
    for s in range(4):
        for t in NEXT[s]:
            offer(s, t, label(t), 1, "keep" if role == t else "relabel")
        if s:
            offer(s, s, MERGE + label(s), 0, "merge")
        for x in NEXT[s]:
            for t in NEXT[x]:
                offer(s, t, INSERT + label(t), 2, "keep" if role == t else "relabel", x)
    return best


STEPS = [_steps(r) for r in range(4)]
_PLAIN = [[[None if x is None else x[:2] for x in row] for row in m] for m in STEPS]
#: Empty turns after the last one, and what they cost.
ENDINGS = {0: ((), 0), 1: ((2, 3), 2 * END_INSERT), 2: ((3,), END_INSERT), 3: ((), 0)}


_TAG, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    return _TAG.sub(r"<\\\1|", text) if "|" in text else text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def role_number(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), 0)


def best_path(roles: list[int], entry: int, ending: int | None) -> tuple[int, list[tuple[int, int]]]:
    """(cost, [(state before, state after)]) from ``entry`` to ``ending`` (None: the cheapest end with its empty turns)."""
    costs = [_FAR] * 4
    costs[entry] = 0
    back = []
    for r in roles:
        new, came = [_FAR] * 4, [-1] * 4
        for s in range(4):
            if costs[s] < _FAR:
                for e, step in enumerate(_PLAIN[r][s]):
                    if step and costs[s] + step[0] < new[e]:
                        new[e], came[e] = costs[s] + step[0], s
        back.append(came)
        costs = new
    ends = [costs[e] + (ENDINGS[e][1] if ending is None else 0 if e == ending else _FAR) for e in range(4)]
    at = min(range(4), key=lambda e: (ends[e], e))
    total, path = ends[at], []
    for came in reversed(back):
        path.append((came[at], at))
        at = came[at]
    return total, path[::-1]


def outputs(roles: list[int], path: list[tuple[int, int]]) -> int:
    return sum(STEPS[r][s][e][1] for r, (s, e) in zip(roles, path, strict=True))


def repair(turns: list[tuple], entry: int = 0, ending: int | None = None, base: int = 0, last: bool = True):
    """Pieces (seq, turn, role, action, rendered) of (turn, role, text) in order; ``base`` turns were put out before."""
    roles = [role_number(t[1]) for t in turns]
    _, path = best_path(roles, entry, ending)
    seq, out = base, []

    def put(turn, role, action, text, opens):
        nonlocal seq
        seq += opens
        head = ("<|end|>\n" if seq > 1 else "") + f"<|{ROLES[role]}|>\n" if opens else "\n"
        out.append([seq - 1, turn, ROLES[role], action, head + text])

    state = entry
    for (turn, _, text), r, (s, e) in zip(turns, roles, path, strict=True):
        _, _, action, empty = STEPS[r][s][e]
        if empty:
            put(None, empty, "insert", "", True)
        put(turn, e, action, escaped(text or ""), action != "merge")
        state = e
    if last:
        for x in ENDINGS[state][0]:
            put(None, x, "insert", "", True)
        if out:
            out[-1][4] += "<|end|>\n"
    return out


def _chunks(batches, extra: int = 0):
    """Rows of each (conv, chunk): columns conv, chunk, turn, role, text and ``extra`` more; sorted by the first two."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if held:
                    yield key, held
                held, key = [], row[:2]
            held.append(row[2:])
    if held:
        yield key, held


def _reduced(batches):
    import pyarrow as pa

    rows = []
    for (conv, chunk), turns in _chunks(batches):
        roles = [role_number(t[1]) for t in turns]
        costs, outs = [], []
        for s in range(4):
            for e in range(4):
                cost, path = best_path(roles, s, e)
                costs.append(min(cost, _FAR))
                outs.append(outputs(roles, path) if cost < _FAR else 0)
        rows.append((conv, chunk, costs, outs))
        if len(rows) == 1000:
            yield _as_batch(rows, _MATRIX)
            rows = []
    if rows:
        yield _as_batch(rows, _MATRIX)


def _combined(batches):
    """For each conversation the states at its chunks' edges and how many turns were put out before each chunk.

    Of a chunk only the states that it comes from and its 16 counts of turns are held, some 150 bytes.
    """
    rows, key = [], None

    def fresh():
        return [0, _FAR, _FAR, _FAR], array("q"), bytearray(), array("q")

    costs, chunks, back, outs = fresh()

    def close():
        at = min(range(4), key=lambda e: (costs[e] + ENDINGS[e][1], e))
        edges = bytearray([at])
        for k in range(len(chunks) - 1, -1, -1):
            at = back[4 * k + at]
            edges.append(at)
        edges.reverse()
        base = 0
        for k, chunk in enumerate(chunks):
            yield (key[0], chunk, edges[k], edges[k + 1], base, k == len(chunks) - 1)
            base += outs[16 * k + 4 * edges[k] + edges[k + 1]]

    for batch in batches:
        for conv, chunk, m, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (conv,):
                if key is not None:
                    for row in close():
                        rows.append(row)
                        if len(rows) == 1000:
                            yield _as_batch(rows, _EDGES)
                            rows = []
                key, (costs, chunks, back, outs) = (conv,), fresh()
            steps = [min((costs[s] + m[4 * s + e], s) for s in range(4)) for e in range(4)]
            costs = [min(c, _FAR) for c, _ in steps]
            back.extend(s for _, s in steps)
            chunks.append(chunk)
            outs.extend(n)
    if key is not None:
        rows += close()
    if rows:
        yield _as_batch(rows, _EDGES)


def _repaired(batches):
    rows = []
    for (conv, _), turns in _chunks(batches):
        entry, ending, base, last = turns[0][3:7]
        rows += [(conv, *piece) for piece in repair([t[:3] for t in turns], entry, ending, base, last)]
        if len(rows) > 2000:
            yield _as_batch(rows, _PIECES)
            rows = []
    if rows:
        yield _as_batch(rows, _PIECES)


_MATRIX = {"conv": "int64", "chunk": "int64", "costs": "list<int64>", "outs": "list<int64>"}
_EDGES = {"conv": "int64", "chunk": "int64", "entry": "int64", "ending": "int64", "base": "int64", "last": "bool"}
_PIECES = {"conv_id": "int64", "seq": "int64", "turn": "int64", "role": "string", "action": "string", "rendered": "string"}


def _as_batch(rows, schema):
    import pyarrow as pa

    kinds = {"int64": pa.int64(), "bool": pa.bool_(), "string": pa.string(), "list<int64>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), schema.values(), strict=True)], names=list(schema))


def _ddl(schema) -> str:
    names = {"int64": "long", "bool": "boolean", "string": "string", "list<int64>": "array<long>"}
    return ", ".join(f"{n} {names[k]}" for n, k in schema.items())


def format_chats(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The pieces of the repaired, rendered conversations of ``df``."""
    late = F.lit(_LATE) + F.pmod(F.xxhash64(col(role_col), col(text_col)), F.lit(NULL_CHUNKS))
    rows = df.select(col(conv_col).cast("long").alias("conv"), F.coalesce(F.shiftright(col(turn_col).cast("long"), CHUNK.bit_length() - 1), late).cast("long").alias("chunk"), col(turn_col).cast("long").alias("turn"), col(role_col).alias("role"), col(text_col).alias("text"))
    order = ["conv", "chunk", F.col("turn").asc_nulls_last(), "role", "text"]
    dealt = rows.repartition("conv", "chunk").sortWithinPartitions(*order)
    matrices = written(dealt.mapInArrow(_reduced, _ddl(_MATRIX)), "chat-chunks")
    edges = matrices.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_combined, _ddl(_EDGES))
    edges = written(edges, "chat-edges")
    joined = rows.join(edges, rows["conv"].eqNullSafe(edges["conv"]) & (rows["chunk"] == edges["chunk"])).select(rows["conv"], rows["chunk"], "turn", "role", "text", "entry", "ending", "base", "last")
    return joined.repartition("conv", "chunk").sortWithinPartitions(*order).mapInArrow(_repaired, _ddl(_PIECES))


def op3_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
