"""Exact token counts of every prefix by dynamic programming over byte-pair tokens.

For a byte-pair encoder, the encoding of a prefix is the encoding of some
shorter prefix plus one last token. A token t may follow the last token u
of that shorter prefix exactly if encoding the bytes of u and t together
gives u and t again, which the merge ranks decide from the two tokens
alone. So one pass over the bytes of a piece finds the last token and the
count at *every* prefix; nothing is ever encoded twice.

The tokenizer first splits a text into pieces that never merge across.
Pieces recur, so a worker keeps the table of each in a bounded table. The
count at any cut of a text is the sum over the whole pieces before it plus
the piece's own entry: truncation points and budgets are look-ups.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import small_batches

#: White space as the tokenizer's split sees it (Unicode White_Space).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the byte-level split (contractions, letters, digits, others, white space).
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+"
                      rf"|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The same split for texts of plain characters alone (ASCII without separators, Latin letters).
PLAIN = re.compile("[\t-\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_L = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
PLAIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\t-\r {_L}0-9]+"
                         r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Bounds of a worker's tables (a full table of pieces is kept once more, so frequent pieces stay).
KNOWN_PIECES, KNOWN_PAIRS = 600_000, 1_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def split(text: str) -> list[str]:
    """The pieces of an ordinary text, which join to the text."""
    return (PLAIN_SPLIT if PLAIN.fullmatch(text) else SPLIT).findall(text)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable bytes stand for themselves, the others for 256, 257, ... in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter(dict):
    """piece (str) -> token count of the whole piece, filled on demand.

    Tokens are numbered by rank: a single byte is its value, the token of
    the i-th merge is 256 + i.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        raw = lambda s: bytes(letters[c] for c in s)
        self.rank = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(merges):
            x, y = raw(a), raw(b)
            pair = (self.rank[x], self.rank[y])
            self.rank[x + y] = 256 + i
            self.halves.append(pair)
            self.merged[pair] = 256 + i
        self.longest = max(map(len, self.rank))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.before: dict[str, int] = {}
        # tokens that their own bytes are encoded as, and every beginning of one
        self.known = {data: t for data, t in self.rank.items() if self.is_sound(t)}
        self.starts = {data[:k] for data in self.known for k in range(1, len(data) + 1)}

    def may_follow(self, u: int, t: int) -> bool:
        """Does encoding the bytes of ``u`` then ``t`` give back exactly (u, t)?

        Undo the merges of both sides from the latest to the earliest. At
        each moment the two tokens at the border could have merged with
        each other; that would have happened first if its rank is lower
        than the merge just undone.
        """
        key = (u, t)
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        merged, halves, undone, ok = self.merged, self.halves, len(self.halves), True
        while True:
            across = merged.get((u, t))
            # at equal rank the left merge is made first
            if across is not None and across < undone:
                ok = False
                break
            if u < 256 and t < 256:
                break
            if u > t:
                undone, u = u, halves[u][1]
            else:
                undone, t = t + 1, halves[t][0]
        self.pairs[key] = ok
        return ok

    def is_sound(self, t: int) -> bool:
        """Is the token ``t`` what its own bytes are encoded as?

        Its halves are sound or it would not be met on the way; undoing
        merges as above, nothing may join across their border before the
        merge that makes ``t``.
        """
        merged, halves = self.merged, self.halves
        todo = [t]
        while todo:
            t = todo.pop()
            if t < 256:
                continue
            u, v = halves[t]
            todo += [u, v]
            undone = t
            while u >= 256 or v >= 256:
                if u > v:
                    undone, u = u, halves[u][1]
                else:
                    undone, v = v + 1, halves[v][0]
                across = merged.get((u, v))
                if across is not None and across < undone:
                    return False
        return True

    def prefix_counts(self, data: bytes) -> list[int]:
        """Token count of ``data[:i]`` for i = 0 .. len(data).

        Forward: from each prefix whose last token is known, every token
        that starts there and may follow settles the longer prefix.
        """
        known, starts, pairs, may_follow = self.known, self.starts, self.pairs, self.may_follow
        size = len(data)
        counts, last = [0] * (size + 1), [-1] * (size + 1)
        for j in range(size):
            u, n = last[j], counts[j] + 1
            for i in range(j + 1, size + 1):
                part = data[j:i]
                t = known.get(part)
                if t is not None:
                    if last[i] < 0:
                        if j:
                            ok = pairs.get((u, t))
                            if ok is None:
                                ok = may_follow(u, t)
                            if not ok:
                                continue
                        last[i], counts[i] = t, n
                elif part not in starts:
                    break
        return counts

    def __missing__(self, piece: str) -> int:
        n = self.before.get(piece)
        if n is None:
            n = self.prefix_counts(piece.encode("utf-8"))[-1]
        if len(piece) <= 256:  # longer ones hardly recur
            if len(self) >= KNOWN_PIECES:
                self.before = dict(self)
                self.clear()
            self[piece] = n
        return n

    def parts(self, text: str):
        """(ordinary text or special string, is it special) in order."""
        if self.at_special is None or not any(s in text for s in self.special):
            yield text, False
            return
        pos = 0
        for m in self.at_special.finditer(text):
            if m.start() > pos:
                yield text[pos:m.start()], False
            yield m.group(), True
            pos = m.end()
        if pos < len(text):
            yield text[pos:], False

    def pieces(self, text: str) -> tuple[list[str], list[int]]:
        """The pieces of a text and their token counts; a special string is one piece, one token."""
        pieces: list[str] = []
        counts: list[int] = []
        for part, special in self.parts(text):
            here = [part] if special else split(part)
            pieces += here
            counts += [1] if special else map(self.__getitem__, here)
        return pieces, counts

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return sum(self.pieces(text)[1])

    def index(self, text: str) -> tuple[list[int], list[int]]:
        """(code point end, tokens up to there) of every piece: the stored
        prefix table, whose inner entries ``prefix_counts`` of a piece gives."""
        pieces, counts = self.pieces(text)
        return list(accumulate(map(len, pieces))), list(accumulate(counts))

    def count_at(self, text: str, cut: int, table: tuple[list[int], list[int]] | None = None) -> int:
        """Tokens of ``text[:cut]`` from the prefix table.

        Only the pieces at the cut can differ in the shorter text: white
        space before it groups differently, and a cut contraction or
        special string falls apart. So the table is read up to 16 code
        points and one whole piece before the cut, and the few code points
        from there on are looked up as pieces of their own.
        """
        ends, totals = table or self.index(text)
        k = bisect_left(ends, max(0, cut - 16))
        while k > 0 and text[ends[k - 1] - 1].isspace():
            k -= 1
        k = max(0, k - 1)
        # a piece start is a safe start unless it lies inside white space
        start, before = (ends[k - 1], totals[k - 1]) if k else (0, 0)
        return before + self.count(text[start:cut])

    def longest_within(self, text: str, limit: int, table: tuple[list[int], list[int]] | None = None) -> int:
        """The largest cut (code points) whose prefix has at most ``limit`` tokens."""
        ends, totals = table or self.index(text)
        if not totals or totals[-1] <= limit:
            return len(text)
        k = bisect_right(totals, limit)  # the first piece that goes beyond
        start, before = (ends[k - 1], totals[k - 1]) if k else (0, 0)
        end = ends[k]
        # just behind the piece a cut regroups white space, and a cut special string joins other signs
        special = next((s for s in self.special if text.startswith(s, end)), "")
        beyond = min(len(text), end + max(1, len(special) - 1))
        if special or text[end - 1].isspace():
            for cut in range(beyond, end, -1):
                if self.count_at(text, cut, (ends, totals)) <= limit:
                    return cut
        # inside it every prefix has its entry; one of limit tokens has at most so many bytes
        near = min(end, start + 16)
        if end > near:
            piece = text[start:start + (limit - before) * self.longest + 16]
            piece = piece[:end - start]
            counts = self.prefix_counts(piece.encode("utf-8"))
            at = list(accumulate(len(c.encode("utf-8")) for c in piece))
            if len(piece) == end - start and self.count_at(text, end, (ends, totals)) <= limit:
                return end
            for i in range(len(piece), near - start, -1):
                if before + counts[at[i - 1]] <= limit:
                    return start + i
        for cut in range(near, start, -1):
            if self.count_at(text, cut, (ends, totals)) <= limit:
                return cut
        return start


_COUNTERS: dict[str, PrefixCounter] = {}


def prefix_counter(path: str) -> PrefixCounter:
    """The worker's counter for one tokenizer file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, limit: int = 1024, tokenizer: str | None = None,
                 with_index: bool = False) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text): doc_id, n_bytes
    (UTF-8), n_tokens, over_limit, limit_chars (code points of the longest
    prefix within ``limit`` tokens), and ``with_index`` the prefix table as
    arrays ends and totals.

    One map over the input, no shuffle; a document's prefix table lives
    only while the document is looked at.

    Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null
    doc_id is kept; repeated rows are counted each; the special string of
    the vocabulary counts as its one token, as the library does by default;
    very long texts are counted whole; an empty table gives an empty
    result; extra columns are ignored whatever their names.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    fields = [docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
              T.StructField("over_limit", T.BooleanType()), T.StructField("limit_chars", T.LongType())]
    if with_index:
        fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ends", "totals")]

    def run(batches):
        counter = prefix_counter(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            tables: tuple[list, list] = ([], [])
            for value in batch.column(1):
                text = value.as_py() or ""
                table = counter.index(text)
                n = table[1][-1] if table[1] else 0
                keep = counter.longest_within(text, limit, table)
                for col, v in zip(out, (len(text.encode("utf-8")), n, n > limit, keep), strict=True):
                    col.append(v)
                if with_index:
                    tables[0].append(table[0])
                    tables[1].append(table[1])
            cols = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.bool_()), pa.array(out[3], pa.int64())]
            if with_index:
                cols += [pa.array(t, pa.list_(pa.int32())) for t in tables]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
