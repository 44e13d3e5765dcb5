"""SentencePiece encoding and decoding with a batched numpy Viterbi pass.

Words of equal length advance together, one end position at a time. The hashes of all substrings that end there probe
the sorted keys of the pieces; vectorised maxima choose the piece and store its length as backpointer.

Unigram models maximise the sum of scores. For BPE models a best sum of scores is not what merging yields, so the pass
uses a constraint instead of scores: BPE of a prefix ends in the piece t exactly if t follows the last piece of the
shorter prefix and merging the two pieces' characters gives those two pieces again. Exactly one piece meets it at each
position, so the maximum over admissible pieces is the model's own result. Pair checks are memoised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_slices, worker_state
from .words import Table, cut, gather

SPACE = "▁"
#: Marks where texts are cut, and what stands for it in a text that holds it.
CUT, CUT_TEXT = "\x01", "\U0010fffd"
#: Words above so many characters are cut where no piece spans; parts above WINDOW go by windows.
LONG, WINDOW, OVERLAP = 48, 512, 128
FREE, HALF, SLOTS = -(1 << 40), 1 << 21, 1 << 21
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Pieces:
    """Vocabulary of a model: normal pieces with scores, and the ids of byte pieces."""

    texts: list[str]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    unigram: bool = False
    dummy_prefix: bool = True
    memo: tuple = field(default_factory=lambda: (np.full(SLOTS, -1), np.zeros(SLOTS, bool)))

    @classmethod
    def read(cls, path: str, *, unigram: bool = False) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        texts = [m.id_to_piece(i) for i in range(n)]
        normal = np.array([not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n)])
        byte_ids = np.full(256, -1)
        for i in range(n):
            if m.is_byte(i):
                byte_ids[int(texts[i][3:5], 16)] = i
        return cls(texts, np.array([m.get_score(i) for i in range(n)]), normal, byte_ids, m.unk_id(), unigram)

    def __post_init__(self) -> None:
        self.by_text = {t: i for i, t in enumerate(self.texts) if self.normal[i]}
        self.longest = max(map(len, self.by_text), default=1)
        ids = np.fromiter(self.by_text.values(), np.int64, len(self.by_text))
        keys = np.array([_hash_one(t) for t in self.by_text], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ids = keys[order], ids[order]
        # The pieces' characters, so that a probe that meets a key is compared as text.
        self.code_size = np.zeros(len(self.texts), np.int64)
        self.code_size[ids] = np.fromiter(map(len, self.by_text), np.int64, len(self.by_text))
        self.code_at = np.cumsum(self.code_size) - self.code_size
        self.codes = np.frombuffer("".join(t for t, _ in sorted(self.by_text.items(), key=lambda x: x[1])).encode("utf-32-le"), np.uint32)
        self.hint = np.zeros(1 << 20, bool)  # hashes that can't be keys are told by 20 bits
        self.hint[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        # Characters that no longer piece holds never merge: texts are cut around them.
        inner = set("".join(t for t in self.by_text if len(t) > 1))
        self.cut_lines = "\n" not in inner
        # Nor do neighbours that no piece holds side by side: long words are cut there. Runs of unknown characters stay together
        # where they are one piece.
        self.pairs = {t[i : i + 2] for t in self.by_text for i in range(len(t) - 1)} if self.byte_ids[0] >= 0 else None
        if any(SPACE in t.lstrip(SPACE) for t in self.by_text):
            raise ValueError("a piece holds a space after another character")

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("texts", "scores", "normal", "byte_ids", "unknown", "unigram", "dummy_prefix")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, memo=(np.full(SLOTS, -1), np.zeros(SLOTS, bool)))
        self.__post_init__()

    def together(self, left: str, right: str) -> bool:
        """Whether merging the characters of both pieces, best score and then leftmost pair first, ends in these two."""
        s, n = list(left + right), len(left)
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                k = self.by_text.get(s[i] + s[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            if sum(map(len, s[: at + 1])) == n:
                return False
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s == [left, right]


def _hash_one(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(BASE) + (ord(c) + 1) * int(MIX)) & 0xFFFFFFFFFFFFFFFF
    return h


def _viterbi(p: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids of words of one length, and their number for each word; a character without a piece is -1 - code point."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    b, n = codes.shape
    prefix = np.zeros((n + 1, b), np.uint64)
    powers = np.ones(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            prefix[j + 1] = prefix[j] * BASE + (codes[:, j].astype(np.uint64) + np.uint64(1)) * MIX
            powers[j + 1] = powers[j] * BASE
    last = np.zeros((n + 1, b), np.int64)  # the piece that ends at a position
    back = np.zeros((n + 1, b), np.int16)
    total = np.zeros((n + 1, b))
    worst = float(p.scores.min()) - 10.0
    flat = codes.ravel()
    for j in range(1, n + 1):
        # All widths at once: row w - 1 of these tables is the substring of width w that ends at j.
        most = min(j, p.longest)
        starts = np.arange(j - 1, j - 1 - most, -1)
        with np.errstate(over="ignore"):
            h = (prefix[j] - prefix[starts] * powers[1 : most + 1, None]).ravel()
        cells = np.flatnonzero(p.hint[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(p.keys, h[cells]), len(p.keys) - 1)
        found = (p.keys[at] == h[cells]) & (p.code_size[p.key_ids[at]] == cells // b + 1)
        cells, piece = cells[found], p.key_ids[at[found]]
        i, rows = starts[cells // b], cells % b
        differ = gather(flat, rows * n + i, j - i) != gather(p.codes, p.code_at[piece], j - i)
        if differ.any():
            same = np.bincount(np.repeat(np.arange(len(cells)), j - i), differ, len(cells)) == 0
            cells, piece = cells[same], piece[same]
        single = -1 - codes[:, j - 1].astype(np.int64)  # a character is a part even where no piece is it
        one = cells < b
        single[cells[one]] = piece[one]
        cells, piece = np.concatenate([np.arange(b), cells[~one]]), np.concatenate([single, piece[~one]])
        i, rows = starts[cells // b], cells % b
        gain = np.full(most * b, -np.inf)
        if p.unigram:
            gain[cells] = np.where(piece >= 0, p.scores[np.maximum(piece, 0)], worst) + total[i, rows]
        else:
            gain[cells] = np.where(_admissible(p, last[i, rows], piece, i), j - i, -np.inf)
        width = gain.reshape(most, b).argmax(0)
        pieces = np.zeros(most * b, np.int64)
        pieces[cells] = piece
        chosen = width * b + np.arange(b)
        last[j], back[j], total[j] = pieces[chosen], width + 1, gain[chosen]
    ids = np.full((b, n), FREE, np.int64)
    at, rows, k = np.full(b, n), np.arange(b), n
    while (left := at > 0).any():
        k -= 1
        ids[:, k] = np.where(left, last[at, rows], FREE)
        at = np.where(left, at - back[at, rows], at)
    keep = ids != FREE
    return ids[keep], keep.sum(1)


def _admissible(p: Pieces, before: np.ndarray, piece: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each piece may follow the one before it; at the start of a word any may."""
    out = starts == 0
    rows = np.flatnonzero(~out)
    if not len(rows):
        return out
    key = ((before[rows] + HALF) << 22) | (piece[rows] + HALF)
    keys, ok = p.memo
    with np.errstate(over="ignore"):
        slot = (key.astype(np.uint64) * BASE >> np.uint64(43)).astype(np.int64)
    found = keys[slot] == key
    result = ok[slot]
    if not found.all():
        fresh, first, inverse = np.unique(key[~found], return_index=True, return_inverse=True)
        text = lambda k: p.texts[k] if k >= 0 else chr(-1 - k)
        mask = (1 << 22) - 1
        new = np.fromiter((p.together(text((k >> 22) - HALF), text((k & mask) - HALF)) for k in fresh.tolist()), bool, len(fresh))
        result[~found] = new[np.ravel(inverse)]
        to = slot[~found][first]
        keys[to] = -1
        for k, t, v in zip(fresh.tolist(), to.tolist(), new.tolist(), strict=True):  # pairs that share a slot: the last stays
            keys[t], ok[t] = k, v
    out[rows] = result
    return out


def _stitched(p: Pieces, word: str) -> np.ndarray | None:
    """Raw piece ids of a very long word from windows of one length that overlap, all in one pass; None where they don't meet.

    Merges are decided between neighbours: if every two neighbouring pieces are what merging gives, the whole is. So windows may
    be joined at a piece that both hold in the same place. Best sums of scores have no such property.
    """
    if p.unigram:
        return None
    starts = [*range(0, len(word) - WINDOW, WINDOW - OVERLAP), len(word) - WINDOW]
    ids, count = _viterbi(p, [word[a : a + WINDOW] for a in starts])
    out: list[np.ndarray] = []
    left, reached = 0, np.zeros(0, np.int64)  # pieces of the window before from here on, and their places
    before = np.zeros(0, np.int64)
    for a, part in zip(starts, np.split(ids, np.cumsum(count)[:-1]), strict=True):
        size = np.fromiter((len(p.texts[i]) if i >= 0 else 1 for i in part.tolist()), np.int64, len(part))
        places = a + np.cumsum(size) - size
        if not len(before):
            left, before, reached = 0, part, places
            continue
        _, x, y = np.intersect1d(reached, places, assume_unique=True, return_indices=True)
        same = (before[x] == part[y]) & (x >= left)
        if not same.any():
            return None
        k = int(np.argmax(same))
        out.append(before[left : x[k] + 1])
        left, before, reached = int(y[k]) + 1, part, places
    return np.concatenate([*out, before[left:]])


class Encoder:
    """Encodes texts word by word; results of words are kept in a cache of flat arrays, bounded in words and in their characters."""

    def __init__(self, pieces: Pieces, most_words: int = 600_000, slice_rows: int = 20_000) -> None:
        self.p, self.most, self.rows = pieces, most_words, slice_rows
        self.chars = 0
        self.pattern = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if pieces.cut_lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.table = Table(np.int32)

    def _learn(self, words: list[str], whole: bool = False) -> None:
        """Store the pieces of words; long ones (texts without spaces) are put together from their parts."""
        by_length: dict[int, list[str]] = {}
        long: list[tuple[str, list[str]]] = []
        for w in words:
            if not w:
                self.table.add([w], np.zeros(0, np.int64), np.zeros(1, np.int64))
            elif len(w) > LONG and not whole and self.p.pairs is not None:
                ends = [0, *(i for i in range(1, len(w)) if w[i - 1 : i + 1] not in self.p.pairs), len(w)]
                long.append((w, [w[a:b] for a, b in zip(ends, ends[1:], strict=False)]))
            elif len(w) > WINDOW and (stitched := _stitched(self.p, w)) is not None:
                self._store([w], stitched, np.array([len(stitched)]))
            else:
                by_length.setdefault(len(w), []).append(w)
        own = {w for w, parts in long if len(parts) == 1}
        if long:
            self._learn(sorted(own | set(self.table.missing(list(dict.fromkeys(x for w, parts in long if w not in own for x in parts))))), whole=True)
        for n, group in sorted(by_length.items()):
            group = self.table.missing(group)  # a part may have been a word too
            step = max(1, self.rows // n)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                self._store(part, *_viterbi(self.p, part))
        for w, parts in long:
            if w not in own:
                starts, size = self.table.spans(self.table.places(parts))
                self.table.add([w], gather(self.table.flat, starts, size), np.array([size.sum()]))

    def _store(self, words: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        if (ids < 0).any():
            ids, count = self._spelled(ids, count)
        self.table.add(words, ids, count)

    def _spelled(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as byte pieces, or one unknown piece for each run of them."""
        out: list[int] = []
        size = []
        start = 0
        for e in np.cumsum(count).tolist():
            one: list[int] = []
            for i in ids[start:e].tolist():
                if i >= 0:
                    one.append(i)
                elif self.p.byte_ids[0] >= 0:
                    one.extend(int(self.p.byte_ids[x]) for x in chr(-1 - i).encode())
                elif not one or one[-1] != self.p.unknown:
                    one.append(self.p.unknown)
            out += one
            size.append(len(one))
            start = e
        return np.array(out, np.int64), np.array(size, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the end of each text in them."""
        prefix = SPACE if self.p.dummy_prefix else ""
        texts = pc.replace_substring(texts, " ", SPACE)
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(prefix, texts, ""))
        # Runs of spaces are one part with the word after them; texts with such runs are marked at the places a pattern finds.
        marked = pc.replace_substring(texts, SPACE, CUT + SPACE)
        if self.p.cut_lines:
            marked = pc.replace_substring(marked, "\n", CUT + "\n" + CUT)
        odd = pc.or_(pc.match_substring(texts, SPACE + SPACE), pc.match_substring(texts, CUT))
        if pc.any(odd).as_py():
            keep = odd.to_pylist()
            slow = [CUT.join(self.pattern.findall(t.replace(CUT, CUT_TEXT))) if o else m for t, m, o in zip(texts.to_pylist(), marked.to_pylist(), keep, strict=True)]
            marked = pa.array(slow, pa.string())
        codes, count, words = cut(marked, CUT)
        words = [w.replace(CUT_TEXT, CUT) for w in words]
        if len(self.table.index) > self.most or self.chars > 16 * self.most:
            self.table.keep_half()
            self.chars = sum(map(len, self.table.index))
        fresh = self.table.missing([w for w in words if w])
        self.chars += sum(map(len, fresh))
        self._learn(fresh + ([""] if "" not in self.table.index else []))
        starts, size = self.table.spans(self.table.places(words))
        ids = gather(self.table.flat, starts[codes], size[codes])
        return ids, np.concatenate([[0], np.cumsum(size[codes])])[np.cumsum(count)]


def decode(p: Pieces, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """Texts of id runs: pieces joined, bytes taken as UTF-8 (bad sequences become U+FFFD), spaces restored, dummy prefix dropped."""
    raw = getattr(p, "raw", None)
    if raw is None:
        byte_of = {int(i): bytes([b]) for b, i in enumerate(p.byte_ids) if i >= 0}
        raw = p.raw = [byte_of.get(i, t.encode() if p.normal[i] else (" ⁇ ".encode() if i == p.unknown else b"")) for i, t in enumerate(p.texts)]
        p.raw = raw = [x.replace(SPACE.encode(), b" ") for x in raw]
    pieces = list(map(raw.__getitem__, ids.tolist()))
    out, start = [], 0
    for e in ends.tolist():
        t = b"".join(pieces[start:e]).decode("utf-8", "replace")
        out.append(t[1:] if p.dummy_prefix and t.startswith(" ") else t)
        start = e
    return out


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", unigram: bool = False) -> DataFrame:
    """``(id, ids array<int>, n_tokens, decoded_ok)`` per row: the piece ids, and whether decoding them gives the text again.

    Null text: as empty (no ids). Texts that hold U+2581 themselves decode to spaces, as in the library. Very long texts are
    encoded whole, words of any length. Repeated rows are encoded each; other columns are not read. The vocabulary is read
    on the driver and broadcast (its size is the model's); a worker builds its tables once.
    """
    small_batches(docs.sparkSession)
    pieces = Pieces.read(model_path, unigram=unigram)
    name = (_hash_one("".join(pieces.texts)), float(pieces.scores.sum()), unigram)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    wanted = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("pieces", name), lambda: Encoder(shared.value))
        for whole in batches:
            for b in text_slices(whole, "text"):
                texts = b.column(1).to_pylist()
                ids, ends = encoder.encode(b.column(1))
                ok = [a == t.replace(SPACE, " ") for a, t in zip(decode(encoder.p, ids, ends), texts, strict=True)]
                offsets = np.concatenate([[0], ends])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(ok)], names=[id_col, "ids", "n_tokens", "decoded_ok"]
                )
            pa.default_memory_pool().release_unused()

    kind = wanted.schema[id_col].dataType.simpleString()
    return wanted.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens bigint, decoded_ok boolean")
