"""Token counts by a finite-state transducer compiled from a byte-pair piece model.

The encoding of a text by ranked merges has this property: its last piece is the one piece that ends there and is
compatible with the last piece of what stands before it, where two pieces are compatible if merging their joined
string gives these two again. So a left-to-right machine can give the number of pieces: its state is the longest
ending of the text that begins some piece, with the last piece and the relative count at each place inside that
ending; a transition reads a character and is annotated with the change of the count. States are compiled when
first needed and kept in a bounded store.

Pieces hold the space mark at their beginning only (checked when the model is read), so the machine is in its start
state wherever a mark follows another character, and at characters that no longer piece contains, such as line
breaks. Between these cuts whole segments are one transition of a macro machine, with their counts kept per worker.
A long text is summarised in chunks, each a map (open head, count, open tail); maps compose associatively and are
combined pairwise, as in a prefix scan, so no chunk waits for the one before it.

Null texts are empty and have no tokens; equal rows give equal results; other columns are ignored; an empty table
gives an empty result. The counts are the library's own, without added special tokens.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters of one chunk of a long text.
CHUNK = 1 << 18
#: Segments and states that a worker keeps; beyond it a store starts anew.
KEPT_SEGMENTS = 600_000
KEPT_STATES = 150_000
KEPT_PAIRS = 500_000


class State:
    """Endings of the text that begin a piece, longest first, down to the empty one, and for each the last piece
    before it and the count up to it relative to the count up to here."""

    __slots__ = ("endings", "last", "ahead", "next")

    def __init__(self, endings: tuple, last: tuple, ahead: tuple):
        self.endings, self.last, self.ahead = endings, last, ahead
        self.next: dict[str, tuple[int, State]] = {}


class PieceTransducer:
    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        plain = [i for i in every if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("pieces with a space mark inside aren't supported")
        bytes_of = {m.id_to_piece(i) for i in every if m.is_byte(i)}
        self.by_bytes = len(bytes_of) == 256
        self.starts = {p[:k] for p in self.score for k in range(1, len(p))}
        self.joined = {c for p in self.score if len(p) > 1 for c in p}
        self.longest = max(map(len, self.score))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.own: dict[str, bool] = {}
        self.steps = 0
        self._clear()
        self.segments: dict[str, int] = {}
        self.line_break = 0 if "\n" in self.joined else self.alone("\n")

    def _clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state(("",), (None,), (0,))

    def state(self, endings: tuple, last: tuple, ahead: tuple) -> State:
        key = (endings[0], last, ahead)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(endings, last, ahead)
        return found

    def alone(self, c: str) -> int:
        return 1 if c in self.score or not self.by_bytes else len(c.encode("utf-8", "surrogatepass"))

    def merged(self, text: str) -> list[str]:
        """Ranked merging by definition, for short strings."""
        parts = list(text)
        while True:
            best = max(((self.score.get(parts[i] + parts[i + 1], float("-inf")), -i) for i in range(len(parts) - 1)), default=(float("-inf"), 0))
            if best[0] == float("-inf"):
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge gives this one, or None for a character."""
        found = self.split.get(piece, 0)
        if found == 0:
            parts = list(piece)
            while len(parts) > 2:
                i = -max((self.score.get(parts[i] + parts[i + 1], float("-inf")), -i) for i in range(len(parts) - 1))[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = self.split[piece] = tuple(parts) if len(parts) == 2 else None
        return found

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the joined string of two pieces gives these two again.

        The border is first reached by the characters on both sides; undoing the later of the two merges next to it,
        again and again, runs through the pairs that meet at the border, and none may merge before its time came.
        """
        key = (a, b)
        found = self.pairs.get(key)
        if found is not None:
            return found
        score, one = self.score.get, float("inf")
        below, side, good = float("-inf"), 0, True
        while True:
            s = score(a + b)
            if s is not None and (s > below or (s == below and side == 1)):
                good = False
                break
            left = score(a, one) if len(a) > 1 else one
            right = score(b, one) if len(b) > 1 else one
            if left == one and right == one:
                break
            if left < right:  # the left piece was merged later
                below, side = left, 0
                a = self.halves(a)[1]
            else:  # at equal scores the left one is merged first
                below, side = right, 1
                b = self.halves(b)[0]
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def step(self, s: State, c: str) -> tuple[int, State]:
        """Compile the transition of a state for a character."""
        self.steps += 1
        score, starts = self.score, self.starts
        piece, change = c, None
        grown = [e + c for e in s.endings]
        for i, text in enumerate(grown):  # the longest piece first
            if text in score and self.whole(text) and (s.last[i] is None or self.compatible(s.last[i], text)):
                piece, change = text, s.ahead[i] + (1 if len(text) > 1 else self.alone(text))
                break
            if len(text) == 1:
                piece, change = text, s.ahead[i] + self.alone(text)
                break
        live = [i for i, text in enumerate(grown) if text in starts]
        endings = (*(grown[i] for i in live), "")
        last = (*(s.last[i] for i in live), piece)
        ahead = (*(s.ahead[i] - change for i in live), 0)
        out = s.next[c] = (change, self.state(endings, last, ahead))
        return out

    def whole(self, piece: str) -> bool:
        """Whether merging the piece's own characters gives the piece."""
        found = self.own.get(piece)
        if found is None:
            found = self.own[piece] = self.merged(piece) == [piece]
        return found

    def run(self, segment: str) -> int:
        """Tokens of a segment, from the start state."""
        if len(self.states) > KEPT_STATES:
            self._clear()
        s, total = self.start, 0
        for c in segment:
            t = s.next.get(c)
            if t is None:
                t = self.step(s, c)
            total += t[0]
            s = t[1]
        return total

    def segment(self, text: str) -> int:
        n = self.segments.get(text)
        if n is None:
            if len(self.segments) > KEPT_SEGMENTS:
                self.segments.clear()
            n = self.segments[text] = self.run(text)
        return n

    def words(self, words: list[str]) -> int:
        """Tokens of space-led words."""
        known = self.segments
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            return sum(map(self.segment, words))

    def marked(self, line: str) -> int:
        """Tokens of a marked text that may have runs of marks, cut where a mark follows another character."""
        total, at = 0, 0
        for i in range(1, len(line)):
            if line[i] == MARK and line[i - 1] != MARK:
                total += self.segment(line[at:i])
                at = i
        return total + (self.segment(line[at:]) if line else 0)

    def line(self, line: str) -> int:
        """Tokens of a marked text without breaks."""
        head, *rest = line.split(MARK)
        if "" in rest:
            return self.marked(line)
        return (self.segment(head) if head else 0) + self.words([MARK + w for w in rest])

    def summary(self, chunk: str) -> tuple[str, int, str] | str:
        """The map of a chunk: (head before its first cut, tokens between, tail from its last cut), or its text."""
        cuts = (i for i in range(1, len(chunk)) if chunk[i] == MARK and chunk[i - 1] != MARK)
        first = next(cuts, None)
        if first is None:
            return chunk
        last = len(chunk) - 1
        while not (chunk[last] == MARK and chunk[last - 1] != MARK):
            last -= 1
        return chunk[:first], self.plain(chunk[first:last]), chunk[last:]

    def compose(self, a, b):
        if isinstance(a, str) and isinstance(b, str):
            return self.summary(a + b)
        if isinstance(a, str):
            s = self.summary(a + b[0])
            return (a + b[0], b[1], b[2]) if isinstance(s, str) else (s[0], s[1] + self.plain(s[2]) + b[1], b[2])
        if isinstance(b, str):
            s = self.summary(a[2] + b)
            return (a[0], a[1], a[2] + b) if isinstance(s, str) else (a[0], a[1] + self.plain(s[0]) + s[1], s[2])
        return a[0], a[1] + self.plain(a[2] + b[0]) + b[1], b[2]

    def plain(self, marked: str) -> int:
        if not self.line_break:
            return self.line(marked)
        lines = marked.split("\n")
        return sum(map(self.line, lines)) + self.line_break * (len(lines) - 1)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if len(marked) <= CHUNK:
            return self.plain(marked)
        maps = [self.summary(marked[i : i + CHUNK]) for i in range(0, len(marked), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        last = maps[0]
        return self.plain(last) if isinstance(last, str) else self.plain(last[0]) + last[1] + self.plain(last[2])


@cache
def load(path: str) -> PieceTransducer:
    """One transducer for each worker process and model."""
    return PieceTransducer(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` (doc_id, text)."""

    def count(batches):
        machine = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts = [machine.count(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
