"""Encoding to and decoding from the pieces of a public byte-pair vocabulary.

Pairs of neighbouring symbols are merged by score, of equal ones the leftmost first, until
no two make a piece.  The merges needn't be played through: a list of pieces is the
encoding of its text if each two neighbours are the encoding of theirs, since the first
merge over a border would be one in that pair too.  So a prefix of a text has just one last
piece: a piece that ends there (an automaton finds all of these), whose beginning is the
end of a prefix with a last piece that it may follow.  The table of last pieces is filled
from the left in time linear in the text, and ids are read off it backwards.

Whether two pieces may stand side by side is told by their edges: the pieces that grow at
the right end of the left one and at the left end of the right one, each until the merge
that makes the next.  A merge over the border that would come before both of these says
no.  That takes pieces of scores of their own that fall from parts to wholes; others, such
as runs of blanks of one score, are merged once and remembered.

No merge crosses a border that lies within no piece.  Texts are cut before runs of blanks,
around letters that stand in no longer piece and, if no piece mixes them, between letters
and signs (this is checked as the vocabulary is loaded), and the ids of short segments are
remembered.

Defined results: a null text is an empty one, which has the end id alone.  Ids without
bytes (begin, end) decode to nothing, bytes that are no UTF-8 to U+FFFD each.  Repeated
rows, null ids and further columns are kept as they are read, one row each.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.words import slices

BLANK = "▁"
#: Bytes of segments, of those of before, and of pairs that a worker remembers.
MEMORY_BYTES = 128 << 20
#: Longer segments aren't remembered.
LONG = 64
#: Segments that are handled at a time.
GROUP = 1 << 16

ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces with their ids, scores and merges."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(len(model))
        self.text = [model.id_to_piece(i) for i in every]
        self.end = model.eos_id()
        self.bytes = {int(self.text[i][1:-1], 16): i for i in every if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in every if model.is_control(i)}
        self.unknown = {i for i in every if model.is_unknown(i)}
        special = self.control | self.unknown | set(self.byte_of)
        self.ids = {self.text[i]: i for i in every if i not in special}
        self.score = [model.get_score(i) for i in every]
        self.shared = {s for s, n in Counter(self.score[i] for i in self.ids.values()).items() if n > 1}
        self.joint = {i for p, i in self.ids.items() if len(p) > 1 and self.score[i] in self.shared}
        longer = {c for p in self.ids if len(p) > 1 for c in p}
        if any(model.is_unused(i) for i in every) or len(self.bytes) < 256 or self.end < 0 or not longer <= set(self.ids):
            raise ValueError(f"{path}: pieces of every letter in them, bytes and an end id are needed, and none unused")
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError(f"{path}: a piece holds a blank after a letter, so texts can't be cut at blanks")
        if model.normalize(" a  ﬁ\n") != f"{BLANK * 2}a{BLANK * 2}ﬁ\n" or model.normalize(""):
            raise ValueError(f"{path}: the normaliser does more than to write blanks and put one first")
        kinds = ["".join(sorted(c for c in longer - {BLANK} if c.isalpha() is kind)) for kind in (True, False)]
        mixed = re.compile("[{0}][{1}]|[{1}][{0}]".format(*map(re.escape, kinds))) if all(kinds) else None
        if mixed and any(map(mixed.search, self.ids)):
            kinds = ["".join(kinds)]
        runs = [f"{BLANK}*[{re.escape(k)}]+|" for k in kinds if k]
        self.segments = re.compile(f"{''.join(runs)}{BLANK}+|.", re.DOTALL)
        self.found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.found.add_word(piece, (i, len(piece)))
        self.found.make_automaton()
        self.shown = [None if i in special else p.replace(BLANK, " ") for i, p in enumerate(self.text)]
        self.split: dict[int, tuple[int, int] | None] = {}
        self.plain: dict[int, bool] = {}
        self.edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[tuple[int, int, int]]:
        """Ids by playing the merges through, each with the two it was made of (-1 for a letter): for short texts, of letters with ids."""
        now = [(self.ids[c], -1, -1) for c in text]
        while True:
            best, at, into = None, -1, -1
            for j in range(len(now) - 1):
                i = self.ids.get(self.text[now[j][0]] + self.text[now[j + 1][0]])
                if i is not None and (best is None or self.score[i] > best):
                    best, at, into = self.score[i], j, i
            if best is None:
                return now
            now[at : at + 2] = [(into, now[at][0], now[at + 1][0])]

    def parts(self, i: int) -> tuple[int, int] | None:
        """The two pieces that the last merge of this one joins; None for letters and for pieces that no text is encoded to."""
        if i not in self.split:
            found = self.merged(self.text[i])
            self.split[i] = found[0][1:] if len(found) == 1 and found[0][1] >= 0 else None
        return self.split[i]

    def reached(self, i: int) -> bool:
        return len(self.text[i]) == 1 or self.parts(i) is not None

    def is_plain(self, i: int) -> bool:
        """Whether this piece and all it is made of have scores of their own that fall from parts to wholes."""
        if i not in self.plain:
            parts = self.parts(i)
            if parts is None:
                self.plain[i] = len(self.text[i]) == 1
            else:
                lower = all(len(self.text[p]) == 1 or self.score[p] > self.score[i] for p in parts)
                self.plain[i] = self.score[i] not in self.shared and lower and all(map(self.is_plain, parts))
        return self.plain[i]

    def edge(self, i: int, side: int) -> list[int]:
        """The pieces that grow at the left (0) or right (1) end of this one, from the letter to itself."""
        found = self.edges[side].get(i)
        if found is None:
            parts = self.parts(i)
            found = self.edges[side][i] = [i] if parts is None else [*self.edge(parts[side], side), i]
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether the texts of the two pieces together are encoded to these two."""
        if len(self.pairs) * 150 > MEMORY_BYTES:
            self.pairs.clear()
        known = self.pairs[a, b] = self._edges_hold(a, b) if self.is_plain(a) and self.is_plain(b) else self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        return [x[0] for x in self.merged(self.text[a] + self.text[b])] == [a, b]

    def _edges_hold(self, a: int, b: int) -> bool:
        lefts, rights = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while True:
            next_left = self.score[lefts[i + 1]] if i + 1 < len(lefts) else None
            next_right = self.score[rights[j + 1]] if j + 1 < len(rights) else None
            over = self.ids.get(self.text[lefts[i]] + self.text[rights[j]])
            if over is not None:
                score = self.score[over]
                if over in self.joint:
                    return self._stay_apart(a, b)
                if (next_left is None or score > next_left) and (next_right is None or score >= next_right):
                    return False
            if next_left is None and next_right is None:
                return True
            if next_right is None or (next_left is not None and next_left >= next_right):
                i += 1
            else:
                j += 1

    def encode_segment(self, text: str) -> list[int]:
        """Ids of letters that have ids, by the table of last pieces."""
        last, size = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        pairs = self.pairs
        for end, (i, n) in self.found.iter(text):
            to = end + 1
            if last[to] >= 0:
                continue
            if n == to:
                holds = self.reached(i)
            elif (before := last[to - n]) < 0:
                continue
            elif (holds := pairs.get((before, i))) is None:
                holds = self.follows(before, i)
            if holds:
                last[to], size[to] = i, n
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def pieces(self, segment: str) -> list[int]:
        if len(segment) == 1:
            i = self.ids.get(segment)
            return [self.bytes[b] for b in segment.encode()] if i is None else [i]
        return self.encode_segment(segment)

    def cut(self, text: str) -> Iterator[str]:
        """Segments of a text, blanks written and one put first."""
        if not text:
            return iter(())
        return (m[0] for m in self.segments.finditer(BLANK + text.replace(" ", BLANK)))

    def encode(self, text: str | None) -> list[int]:
        return [i for segment in self.cut(text or "") for i in self.pieces(segment)] + [self.end]

    def _bytes_text(self, raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(raw):
                size = next((n for n in (1, 2, 3, 4) if _is_letter(raw[at : at + n], n)), 0)
                out.append(raw[at : at + size].decode() if size else "�")
                at += size or 1
            return "".join(out)

    def spelled(self, ids: list[int]) -> str:
        """The pieces' text with its first blank still there."""
        try:
            return "".join([self.shown[i] for i in ids])
        except TypeError:  # among them bytes or ids without a text
            return self._spelled(ids)

    def _spelled(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(self._bytes_text(bytes(raw)))
                raw.clear()
            if i in self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.shown[i])
        if raw:
            out.append(self._bytes_text(bytes(raw)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; a blank that begins the first piece with a text is the one that encoding put there."""
        first = next((i for i in ids if i not in self.control), None)
        text = self.spelled(ids)
        return text[1:] if first is not None and first not in self.unknown and first not in self.byte_of and self.text[first].startswith(BLANK) else text


def _is_letter(raw: bytes, n: int) -> bool:
    try:
        return len(raw) == n and len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


class Memory(dict):
    """Segment -> (how many ids, the ids in decimal with a blank after each, their text), filled as segments are asked for.

    What was asked for before the last clearing is kept once more, so frequent segments stay.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = MEMORY_BYTES):
        super().__init__()
        self.vocabulary, self.most, self.held, self.older = vocabulary, most, 0, {}

    def __missing__(self, segment: str) -> tuple[int, str, str]:
        found = self.older.get(segment)
        if found is None:
            ids = self.vocabulary.pieces(segment)
            found = len(ids), "".join([f"{i} " for i in ids]), self.vocabulary.spelled(ids)
        if len(segment) <= LONG:
            if self.held > self.most:
                self.older, self.held = dict(self), 0
                self.clear()
            self[segment] = found
            self.held += 400 + 8 * len(segment)
        return found


@cache
def memory(path: str) -> Memory:
    return Memory(Vocabulary(path))


def digests(known: Memory, text: str) -> tuple[int, str, str]:
    """How many ids a text has with the end id, and the digests of the ids and of the text they decode to."""
    ids, plain, n, first = hashlib.sha256(), hashlib.sha256(), 0, True
    cut = known.vocabulary.cut(text)
    while group := list(islice(cut, GROUP)):
        counts, numbers, texts = zip(*map(known.__getitem__, group), strict=True)
        n += sum(counts)
        ids.update("".join(numbers).encode())
        decoded = "".join(texts)
        plain.update((decoded[1:] if first else decoded).encode())  # the blank that encoding put first
        first = False
    ids.update(str(known.vocabulary.end).encode())
    return n + 1, ids.hexdigest(), plain.hexdigest()


def coded(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    at = path or model_path()

    def each(batches):
        known = memory(at)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [digests(known, text or "") for text in part.column("text").to_pylist()]
                n, ids, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(text)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, ROWS)


def encoded(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id and the ids of each text, the end id last."""
    at = path or model_path()

    def each(batches):
        vocabulary = memory(at).vocabulary
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [vocabulary.encode(text) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, ids array<int>")


def decoded(coded_ids: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids; null where the ids are null."""
    at = path or model_path()

    def each(batches):
        vocabulary = memory(at).vocabulary
        for batch in batches:
            text = [None if ids is None else vocabulary.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(text, pa.string())})

    return coded_ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(each, "doc_id long, text string")


def op12_piece_codec(spark, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
