"""Mixture-controlled packing of token streams into fixed windows.

Each source is a queue of tokens. Deficit round-robin serves every window: a
queue earns its share of the window and serves what it has earned, whole
tokens only, so the fraction it could not serve stays as a deficit for the
next window. With tokens as the unit the served total after w windows is
``floor(window * w * share)``, which gives every token's place in closed form:
deficits carry over windows and over Spark partitions without a sequential
pass. When a queue runs dry the shares of the others are scaled up and a new
phase begins; there are at most as many phases as queues. Beyond 256 queues, those
that run dry at about the same time share a place in that round and take turns
within it, which keeps the plan small.

Three steps: (1) one pass tokenizes and writes the ids with each document's
place in its partition's queue; (2) the totals of each partition and queue, a
table of partitions x queues rows, give queue offsets; (3) a second pass cuts
the documents at window and sequence borders.

Only the totals by queue reach the driver, so the number of distinct sources
must be moderate (up to tens of thousands). Ids are kept in 16 bits where the
vocabulary allows it, else in 32. A hot source needs no care: its
rows stay in the partitions they were read in.

Defined results: a null text is empty and packs as the end id alone; a null
source is the queue ''; a text of any length is encoded and held whole by one task,
as ids of 2 or 4 bytes; repeated rows are packed repeatedly; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, materialise, small

#: Shares are whole multiples of 1 / SCALE.
SCALE = 1 << 20
#: Words, and parts with runs of white space, whose ids a worker remembers; later ones are encoded anew.
CACHE, RUNS = 300_000, 40_000
#: Characters of the longest part that is remembered.
KEPT = 64
#: Entries of the tables of tokens served by window and queue that are held at once.
CELLS = 4_000_000
#: Characters whose classes all tokenizer libraries agree on: Latin letters and the signs beside them.
PLAIN = 0x250

#: A space that is no part of a run of white space.
LONE = re.compile(r"(?<=\S) (?=\S)")

_made: dict[str, Words] = {}


class Run(Exception):
    """A space touches other white space."""


class Words(dict):
    """From ' word' to its ids as bytes; what is missing is encoded and, while there is room, kept.

    The pattern of this family of byte-level BPE cuts before every space that
    has something other than white space on both sides, and nothing merges over a
    cut, so a text is the concatenation of its parts between such spaces. A part
    with unusual characters goes to the tokenizer itself, a text with special
    strings does so whole. Python knows every white space that the pattern knows.
    """

    def __init__(self, name: str):
        import base64
        from pathlib import Path

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.kind = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        ranks = Path(name).with_suffix(".tiktoken") if "/" in name else Path(public_tokenizers.path(name)).with_suffix(".tiktoken")
        if ranks.exists():  # the same vocabulary, several times as fast on single words
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
            self.quick = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        else:
            self.quick = None
        self.runs: dict[str, bytes] = {}  # parts that hold runs of white space

    def slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def part(self, part: str, kept: dict[str, bytes], room: int) -> bytes:
        if self.quick is not None and (part.isascii() or max(map(ord, part)) < PLAIN):
            ids = np.array(self.quick(part), self.kind).tobytes()
        else:
            ids = self.slow(part)
        if len(part) <= KEPT and len(kept) < room:
            kept[part] = ids
        return ids

    def __missing__(self, part: str) -> bytes:
        word = part[1:] if part[:1] == " " else part
        if part and (not word or word[-1].isspace() or (word[0].isspace() and word is not part)):
            raise Run
        return self.part(part, self, CACHE)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self.slow(text)
        try:
            first, *rest = text.split(" ")
            return self[first] + b"".join([self[w] for w in map(" ".__add__, rest)])
        except Run:
            first, *rest = LONE.split(text)
            held = self.runs
            return b"".join([held[w] if w in held else self.part(w, held, RUNS) for w in [first, *map(" ".__add__, rest)]])


def words_of(name: str) -> Words:
    if name not in _made:
        _made[name] = Words(name)
    return _made[name]


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source", end_id: int = 0) -> DataFrame:
    """``(id, queue, n, ids, part, before)``: ids with the end id, and the queue's tokens before it in the partition."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        part = TaskContext.get().partitionId()
        words, served = words_of(tokenizer), {}
        end, width = np.array([end_id], words.kind).tobytes(), int(words.kind[-1])
        for batch in batches:
            ids = [words.encode(t or "") + end for t in batch.column(1).to_pylist()]
            sizes, before = [len(x) // width for x in ids], []
            for queue, n in zip(batch.column(2).to_pylist(), sizes, strict=True):
                before.append(served.get(queue, 0))
                served[queue] = before[-1] + n
            for k in range(0, len(ids), 1000):
                cut = slice(k, k + 1000)
                columns = [batch.column(0).slice(k, 1000), batch.column(2).slice(k, 1000), pa.array(sizes[cut], pa.int64()), pa.array(ids[cut], pa.binary()), pa.array([part] * len(sizes[cut]), pa.int32()), pa.array(before[cut], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "queue", "n", "ids", "part", "before"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.coalesce(docs[queue_col].cast("string"), F.lit("")).alias("queue"))
    return batched(rows).mapInArrow(run, f"id {kind}, queue string, n long, ids binary, part int, before long")


def plan_of(totals: dict[str, int], targets: dict[str, float] | None, window: int, flat: int = 256) -> Plan | Bundles:
    """The plan for queues with known totals: one level, or two beyond ``flat`` queues."""
    return Plan(totals, targets, window) if len(totals) <= flat else Bundles(totals, targets, window)


class Bundles:
    """Deficit round-robin on two levels, for many queues.

    A plan keeps an array of its queues for each phase, which grows with the
    square of their number. Here queues that run dry at about the same time are
    bundled; one plan serves the bundles, and one in each bundle serves its queues.
    With bundles of the cube root of n queues the arrays have about n ** (4 / 3)
    entries. What a dry queue leaves goes to its bundle until that is dry too.
    """

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None, window: int):
        self.names = sorted(totals)
        wanted = {k: float(n) if targets is None else max(0.0, targets.get(k, 0.0)) for k, n in totals.items()}
        total = max(1.0, float(sum(totals.values())))
        late = sorted(self.names, key=lambda k: (totals[k] / wanted[k] if wanted[k] else float("inf"), totals[k], k))
        each = max(2, round(len(late) ** (1 / 3)))
        self.inner, self.bundle, self.place = [], np.zeros(len(late), "i8"), np.zeros(len(late), "i8")
        number = {k: i for i, k in enumerate(self.names)}
        for b, c in enumerate(range(0, len(late), each)):
            some = late[c : c + each]
            share = sum(wanted[k] for k in some) / max(sum(wanted.values()), 1e-300) if targets is not None else sum(totals[k] for k in some) / total
            plan = Plan({k: totals[k] for k in some}, {k: wanted[k] for k in some}, max(64, round(window * share)))
            for i, k in enumerate(plan.names):
                self.bundle[number[k]], self.place[number[k]] = b, i
            self.inner.append(plan)
        keys = [f"{b:09d}" for b in range(len(self.inner))]
        self.outer = Plan({k: int(p.total.sum()) for k, p in zip(keys, self.inner, strict=True)}, {k: sum(wanted[n] for n in p.names) for k, p in zip(keys, self.inner, strict=True)}, window)

    def cut(self, queue: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """As `Plan.cut`: places in the bundles' streams first, then theirs in the whole one."""
        found = []
        for k in np.unique(self.bundle[queue]).tolist():
            rows = np.nonzero(self.bundle[queue] == k)[0]
            row, start, length, place = self.inner[k].cut(self.place[queue[rows]], a[rows], b[rows], 1 << 62)
            found.append((rows[row], start, length, place, np.full(len(row), k)))
        if not found:
            return tuple(np.zeros(0, "i8") for _ in range(4))
        row, start, length, place, k = (np.concatenate(x) for x in zip(*found, strict=True))
        piece, more, length, place = self.outer.cut(k, place, place + length, size)
        return row[piece], start[piece] + more, length, place


class Plan:
    """Deficit round-robin over queues with known totals: where each queue's tokens go in the stream."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None, window: int):
        self.window, self.names = window, sorted(totals)
        self.total = np.array([totals[k] for k in self.names], "i8")
        wanted = self.total.astype("f8") if targets is None else np.array([max(0.0, targets.get(k, 0.0)) for k in self.names])
        self.phases = []  # (served by queue before, shares, windows)
        served = np.zeros(len(self.names), "i8")
        while (left := self.total - served).any():
            alive = left > 0
            want = np.where(alive, wanted, 0.0)
            want = want if want.sum() > 0 else alive.astype("f8")  # none of those left has a target: equal shares
            share = np.floor(want / want.sum() * SCALE).astype("i8")
            share[(share == 0) & alive & (want > 0)] = 1
            share[np.argmax(share)] += SCALE - share.sum()
            moving = share > 0
            windows = int(min(-(-int(n) * SCALE // (window * int(q))) for n, q in zip(left[moving], share[moving], strict=True)))
            self.phases.append((served.copy(), share, windows))
            served = served + np.minimum(left, windows * window * share // SCALE)
        self.start = [p[0] for p in self.phases] + [served]

    def given(self, phase: int, w: np.ndarray) -> np.ndarray:
        """Tokens that each queue has served in this phase after ``w`` windows: (len(w), queues)."""
        before, share, _ = self.phases[phase]
        return np.minimum(self.start[phase + 1] - before, w[:, None] * self.window * share // SCALE)

    def cut(self, queue: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Cut the queue intervals [a, b): ``(row, start in the interval, length, place in the stream)``.

        No piece crosses a window or a multiple of ``size`` in the stream.
        """
        out = []
        for p, (before, share, _) in enumerate(self.phases):
            lo, hi = np.maximum(a, before[queue]), np.minimum(b, self.start[p + 1][queue])
            rows = np.nonzero(lo < hi)[0]
            if not len(rows):
                continue
            k, base = queue[rows], before[queue[rows]]
            each = self.window * share[k]
            first = -(-(lo[rows] - base + 1) * SCALE // each) - 1
            last = -(-(hi[rows] - base) * SCALE // each) - 1
            times = last - first + 1
            row, k, base = np.repeat(rows, times), np.repeat(k, times), np.repeat(base, times)
            w = np.repeat(first, times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            rows_at_once = max(1, CELLS // len(self.names))
            for c in range(0, len(row), rows_at_once):
                s = slice(c, c + rows_at_once)
                at, then = self.given(p, w[s]), self.given(p, w[s] + 1)
                ahead = np.cumsum(then - at, axis=1)
                n = np.arange(len(at))
                mine, next_ = at[n, k[s]], then[n, k[s]]
                x = np.maximum(lo[row[s]], base[s] + mine)
                y = np.minimum(hi[row[s]], base[s] + next_)
                place = int(before.sum()) + at.sum(axis=1) + ahead[n, k[s]] - (next_ - mine) + (x - base[s] - mine)
                out.append((row[s], x - a[row[s]], y - x, place))
        if not out:
            return tuple(np.zeros(0, "i8") for _ in range(4))
        row, start, length, place = (np.concatenate(x) for x in zip(*out, strict=True))
        while True:  # a piece is at most a window long, so few turns
            room = size - place % size
            long = np.nonzero(length > room)[0]
            if not len(long):
                break
            tail = (row[long], start[long] + room[long], length[long] - room[long], place[long] + room[long])
            length[long] = room[long]
            row, start, length, place = (np.concatenate(x) for x in zip((row, start, length, place), tail, strict=True))
        keep = length > 0
        return row[keep], start[keep], length[keep], place[keep]


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", targets: dict[str, float] | None = None, size: int = 1024, window: int | None = None, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source``.

    ``targets`` maps queues to token shares; None takes the queues' own shares,
    so that every window has the corpus mixture. A queue without a target is
    served when the others are dry: nothing is dropped. ``window`` is the
    length over which the shares hold (default: one sequence). The stream has
    no gaps, so only the last sequence is padded. With ``with_ids`` the ids
    themselves are returned as little-endian 32-bit bytes.
    """
    made = materialise(tokenize(docs, tokenizer, id_col, text_col, queue_col), "tokens")
    parts = materialise(made.groupBy("part", "queue").agg(F.sum("n").alias("held")), "queues")
    plan = plan_of(dict(parts.groupBy("queue").agg(F.sum("held")).collect()), targets, window or size)
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", "queue", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base"))
    placed = made.join(small(offsets, parts.count()), ["part", "queue"]).select("id", "queue", "n", "ids", (F.col("base") + F.col("before")).alias("a"))
    number = {k: i for i, k in enumerate(plan.names)}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for c in range(0, batch.num_rows, 2000):
                part = batch.slice(c, 2000)
                n, a = part.column(2).to_numpy(), part.column(4).to_numpy()
                queue = np.array([number[q] for q in part.column(1).to_pylist()], "i8")
                held = [x.as_buffer() for x in part.column(3)]
                ids = [np.frombuffer(x, f"<u{x.size // m}").astype("<u4") for x, m in zip(held, n.tolist(), strict=True)]
                row, start, length, place = plan.cut(queue, a, a + n, size)
                held = [ids[r][s : s + m].tobytes() for r, s, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                where = pa.array(row)
                columns = [part.column(0).take(where), pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, held)), pa.int64()), pa.array(n[row]), pa.array(place // size), pa.array(place % size), part.column(1).take(where)]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(held, pa.binary())] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids
    return batched(placed).mapInArrow(run, schema)
