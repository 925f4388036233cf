"""SentencePiece encoding and decoding by streaming Viterbi over a window of piece length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import KEPT, by_bytes, lean, small_batches, utf8_buffer

#: Where the public tokenizers are; a parameter of every operator here.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Words whose committed ids a worker remembers (two generations of half as many).
REMEMBERED = 120_000
#: Pairs of neighbours that a worker remembers.
PAIRS = 250_000
#: Longer words stream through a bounded window and are not remembered.
LONG_UNIT = 64
NEVER = 1 << 60
NONE: dict = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Pieces:
    """A piece vocabulary with the rules of its model file: unigram (best score) or merges (BPE).

    BPE as a path problem: the encoding of any prefix has one last piece, and two pieces may
    follow each other if no merge across their border would have come before the merges that
    made them. So one surviving back pointer per position gives the ids that merging gives.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        parts = dict(_fields(model))
        trainer, normalizer = dict(_fields(parts[2])), dict(_fields(parts[3]))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only unigram and BPE models that leave their text as it is are supported")
        self.prefix = bool(normalizer.get(3, 1))
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.vocab = {self.pieces[i]: i for i in plain}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.longest = max(map(len, self.vocab), default=1)
        self.worst = min((self.scores[i] for i in plain), default=0.0) - 10.0
        order = {s: k for k, s in enumerate(sorted({self.scores[i] for i in plain}, reverse=True))}
        self.rank = {i: order[self.scores[i]] for i in plain}
        # Pieces from their last character back: character -> (further characters, the piece that begins here or -1).
        self.back = self._ends(sorted((text[::-1], i) for text, i in self.vocab.items()), 0)
        self.breaks = not any(SPACE in p.lstrip(SPACE) for p in self.vocab)
        self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.spines: dict[int, tuple[list[int], list[int]] | None] = {}
        self.stand: dict[int, bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        #: Boundaries on which all surviving paths had converged and up to which ids were given out.
        self.commits = 0

    def _ends(self, pieces: list[tuple[str, int]], depth: int) -> dict:
        """Levels of ``back`` for sorted reversed pieces that share their first ``depth`` characters."""
        out: dict[str, tuple[dict, int]] = {}
        at = 0
        while at < len(pieces):
            c, end = pieces[at][0][depth], at
            while end < len(pieces) and pieces[end][0][depth] == c:
                end += 1
            here = len(pieces[at][0]) == depth + 1
            rest = pieces[at + here : end]
            out[c] = (self._ends(rest, depth + 1) if rest else NONE, pieces[at][1] if here else -1)
            at = end
        return out

    # BPE: which pieces may be neighbours.

    def _tree(self, i: int) -> tuple[list[int], list[int]] | None:
        """Left and right spine of a piece's merges, from the outer character up to the piece; None if merging never makes it."""
        if i in self.spines:
            return self.spines[i]
        parts: list[tuple[int, list[int], list[int]]] = []
        for c in self.pieces[i]:
            k = self.vocab.get(c, -1)
            parts.append((k, [k], [k]))
        while len(parts) > 1:
            best, at = NEVER, -1
            for p in range(len(parts) - 1):
                if parts[p][0] < 0 or parts[p + 1][0] < 0:
                    continue
                made = self.vocab.get(self.pieces[parts[p][0]] + self.pieces[parts[p + 1][0]])
                if made is not None and self.rank[made] < best:
                    best, at = self.rank[made], p
            if at < 0:
                break
            (a, left, _), (b, _, right) = parts[at], parts[at + 1]
            made = self.vocab[self.pieces[a] + self.pieces[b]]
            parts[at : at + 2] = [(made, [*left, made], [*right, made])]
        self.spines[i] = (parts[0][1], parts[0][2]) if len(parts) == 1 and parts[0][0] == i else None
        return self.spines[i]

    def _neighbours(self, a: int, b: int) -> bool:
        left, right = self._tree(a), self._tree(b)
        if left is None or right is None:
            return False
        x, y = left[1], right[0]
        i = j = 0
        while True:
            until_x = self.rank[x[i + 1]] if i + 1 < len(x) else NEVER
            until_y = self.rank[y[j + 1]] if j + 1 < len(y) else NEVER
            made = self.vocab.get(self.pieces[x[i]] + self.pieces[y[j]])
            if made is not None and self.rank[made] < until_x and self.rank[made] <= until_y:
                return False
            if until_x == until_y == NEVER:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    # The streaming search.

    def _read(self, text: list[str] | str, i: int, last: list[int | None], size: list[int], best: list[float]) -> None:
        """Take in the i-th character of the window: its back pointer goes to the start of the piece that ends there.

        Under merge rules only one piece can stand last at a position, and what follows does
        not change it, so the search ends at the first that may; else the best score counts.
        """
        node, at = self.back, i
        chosen, start, c = None, i, text[i - 1]
        if self.kind == BPE:
            stand = self.stand
            while at:
                entry = node.get(text[at - 1])
                if entry is None:
                    break
                at -= 1
                node, k = entry
                if k < 0:
                    continue
                p = last[at]
                if p is None:
                    if size[at] < 0 or self._tree(k) is None:
                        continue
                elif p >= 0:
                    key = p << 24 | k
                    ok = stand.get(key)
                    if ok is None:
                        ok = stand[key] = self._neighbours(p, k)
                    if not ok:
                        continue
                elif self._tree(k) is None:
                    continue
                chosen, start = k, at
                break
            if chosen is None and c not in self.vocab:
                chosen, start = -1 - ord(c), i - 1
        else:
            top = -float("inf")
            while at:
                entry = node.get(text[at - 1])
                if entry is None:
                    break
                at -= 1
                node, k = entry
                if k >= 0 and size[at] >= 0 and best[at] + self.scores[k] > top:
                    chosen, start, top = k, at, best[at] + self.scores[k]
            if c not in self.vocab and best[i - 1] + self.worst > top:
                chosen, start, top = -1 - ord(c), i - 1, best[i - 1] + self.worst
            best.append(top)
        last.append(chosen)
        size.append(i - start if chosen is not None else -1)

    def stream(self, chars: Iterable[str], hold: int = 8) -> Iterator[int]:
        """Piece ids of a character stream; an unknown character gives -1 - its code point.

        Only the positions that a later piece can start from are open (at most the longest
        piece's length of them). Where no piece of the vocabulary reaches over a border of
        words, a border is the one open position, on which all back pointers have converged:
        everything before it is given out and forgotten. Elsewhere, once more than ``hold``
        times the longest piece's characters are undecided, the back pointers of the open
        positions are followed to where they meet, and that boundary is committed.
        """
        text: list[str] = []
        last: list[int | None] = [None]
        size, best = [0], [0.0]
        limit = hold * self.longest
        for c in chars:
            n = len(text)
            if n and (n >= limit or self.breaks and c == SPACE and text[-1] != SPACE):
                meet = n if c == SPACE and text[-1] != SPACE and self.breaks else self._meeting(size)
                if meet:
                    yield from self._commit(last, size, meet)
                    base = best[meet] if self.kind != BPE else 0.0
                    # Past a border of words the next piece has no neighbour to agree with.
                    text, size, best = text[meet:], [0, *size[meet + 1 :]], [b - base for b in best[meet:]] or [0.0]
                    last = [None if meet == n and self.breaks else last[meet], *last[meet + 1 :]]
            text.append(c)
            self._read(text, len(text), last, size, best)
        yield from self._commit(last, size, len(text))

    def _commit(self, last: list[int | None], size: list[int], end: int) -> list[int]:
        self.commits += bool(end)
        return self._path(last, size, end)

    def _meeting(self, size: list[int]) -> int:
        """The last boundary that the back pointers of all open positions share (0: none yet)."""
        n = len(size) - 1
        paths = {p for p in range(max(0, n - self.longest + 1), n + 1) if size[p] >= 0}
        while len(paths) > 1:
            far = max(paths)
            paths.remove(far)
            paths.add(far - size[far] if far else 0)
        return paths.pop() if paths else 0

    @staticmethod
    def _path(last: list[int | None], size: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def _ids(self, found: Iterable[int]) -> tuple[int, ...]:
        out: list[int] = []
        for k in found:
            if k >= 0:
                out.append(k)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(-1 - k).encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return tuple(out)

    def _learn(self, units: Iterable[str]) -> None:
        """Remember the ids that the search commits for words, whose borders are boundaries that all paths share.

        Words come in order, and the window goes back only to where a word parts from the
        one before it: the positions up to there are read once.
        """
        before, last, size, best = "", [None], [0], [0.0]
        for unit in sorted(units):
            same, most = 0, min(len(before), len(unit))
            while same < most and before[same] == unit[same]:
                same += 1
            del last[same + 1 :], size[same + 1 :], best[same + 1 :]
            before = unit
            for i in range(same + 1, len(unit) + 1):
                self._read(unit, i, last, size, best)
            self.young[unit] = self._ids(self._commit(last, size, len(unit)))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; empty for an empty one."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; words that are new to the worker are searched together."""
        if not self.breaks:
            return [list(self._ids(self.stream(self._spaced(t)))) if t else [] for t in texts]
        cut = [self.unit.findall(self._spaced(t)) if t else [] for t in texts]
        if len(self.young) >= REMEMBERED // 2:
            self.old, self.young = self.young, {}
        if len(self.stand) > PAIRS:
            self.stand.clear()
        young, old = self.young, self.old
        fresh = set()
        for units in cut:
            fresh.update(units)
        long, learn = {}, []
        for unit in fresh:
            if unit in young:
                continue
            if unit in old:
                young[unit] = old[unit]
            elif len(unit) > LONG_UNIT:
                long[unit] = self._ids(self.stream(unit))
            else:
                learn.append(unit)
        self._learn(learn)
        out = []
        for units in cut:
            ids: list[int] = []
            for unit in units:
                ids += young[unit] if unit in young else long[unit]
            out.append(ids)
        return out

    def _spaced(self, text: str) -> str:
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; control ids are silent, byte runs that are no UTF-8 give U+FFFD."""
        parts: list[str] = []
        run = bytearray()
        pieces, byte_of = self.pieces, self.byte_of
        for i in ids:
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.control:
                parts.append(pieces[i])
        if run:
            parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_LOADED: dict[int, Pieces] = {}
KEPT["pieces"] = _LOADED


def loaded(model: bytes) -> Pieces:
    """One vocabulary per worker process and model."""
    key = zlib.crc32(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def encode_texts(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text and whether they decode to it: (doc_id, ids, n_ids, n_bytes, round_trip).

    The model file (half a megabyte) is read on the driver and travels with the function.
    The model writes spaces as U+2581, so a text's own U+2581 comes back as a space, as
    with the model's library; round_trip compares with that.

    Defined cases: null and empty texts have no ids and are whole; long texts stream through
    a bounded window; characters outside the vocabulary become bytes; repeated rows get
    equal ids; an empty table gives no rows.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches):
        pieces = loaded(model)
        for batch in by_bytes(batches, "text", 2 << 20):
            raw, offsets = utf8_buffer(batch.column(1))
            data = raw.tobytes()
            ends, whole, parts = [0], [], []
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            for text, ids in zip(texts, pieces.encode_all(texts), strict=True):
                whole.append(pieces.decode(ids) == text.replace(SPACE, " "))
                parts.append(np.array(ids, np.int32))
                ends.append(ends[-1] + len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(offsets)), pa.array(whole, pa.bool_())], names=["doc_id", "ids", "n_ids", "n_bytes", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(lean(run, "pieces"), "doc_id long, ids array<int>, n_ids long, n_bytes long, round_trip boolean")


def decode_ids(rows: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists: (doc_id, text); a null list gives a null text."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches):
        pieces = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [None if ids is None else pieces.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(lean(run, "pieces"), "doc_id long, text string")
