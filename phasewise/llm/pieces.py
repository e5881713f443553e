"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The trie holds the UTF-8 bytes of all pieces. No piece has a whitespace marker
behind another character, so a best path never crosses the border before a run
of markers, and a text is the sequence of the best paths of its segments.
Equal segments are encoded once; all new ones of a batch go through the lattice
together, one numpy step for each start and piece length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows
from .vocabularies import FOLDER

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
#: What an unknown character costs below the least log score, a fixed value of the library.
UNKNOWN_PENALTY = 10.0
#: Segments that a worker remembers before it starts anew.
REMEMBERED = 150_000
#: Segments of more bytes go through the lattice alone and aren't remembered.
LONG = 256
_SEGMENT = re.compile(rf" *[^ \n\t{MARKER}]+| +|[\n\t{MARKER}]")


class DoubleArray:
    """base and check arrays; node t follows node s by byte c if t = base[s] + c and check[t] = s. value: piece ids, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, v in keys.items():
            at = 0
            for c in key:
                at = children[at].setdefault(c, len(children))
                if at == len(children):
                    children.append({})
                    values.append(-1)
            values[at] = v
        size = 2 * len(children) + 1024
        base, check, value = (np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32))
        taken = bytearray(size)
        taken[0] = 1
        low, wide, todo = 257, 257, [(0, 0)]
        for node, slot in todo:
            codes = sorted(children[node])
            if not codes:
                continue
            while taken[low]:
                low += 1
            # Single children fill the gaps; wider nodes look on from where the last long search ended.
            b = first = (low if len(codes) == 1 else max(low, wide)) - codes[0]
            while any(taken[b + c] for c in codes):
                b += 1
                if b + 1024 > len(taken):
                    more = len(taken)
                    taken.extend(bytes(more))
                    base, check, value = (np.concatenate((x, np.full(more, fill, np.int32))) for x, fill in ((base, 0), (check, -1), (value, -1)))
            if b - first > 64:
                wide = b + codes[0]
            base[slot] = b
            for c in codes:
                t, child = b + c, children[node][c]
                taken[t], check[t], value[t] = 1, slot, values[child]
                todo.append((child, t))
        self.base, self.check, self.value = base, check, value
        self.longest = max(map(len, keys))


class PieceModel:
    """Pieces with log scores; ids are those of the vocabulary file.

    The file's scores are negative ranks; a piece of rank r gets the logarithm
    of its probability if frequencies follow Zipf's law, log(1 / (r + 1)) less
    that of their sum.
    """

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int]):
        """pieces: (text, id, log score); byte_ids: id of each byte's fallback piece."""
        self.byte_ids = np.array(byte_ids, np.int32)
        self.scores = np.full(max([*(i for _, i, _ in pieces), *byte_ids]) + 1, -np.inf)
        self.bytes: list[bytes] = [b""] * len(self.scores)
        for text, i, score in pieces:
            self.scores[i] = score
            self.bytes[i] = text.replace(MARKER, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        self.trie = DoubleArray({t.replace(MARKER, " ").encode(): i for t, i, _ in pieces})
        self.unknown = min(s for _, _, s in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, ...]] = {}
        self._lists = None

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        n = file.get_piece_size()
        normal = [i for i in range(n) if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i))]
        normal = [i for i in normal if file.id_to_piece(i)]
        rank = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-file.get_score(i), i)))}
        total = math.log(sum(1 / (r + 1) for r in range(len(normal))))
        byte_ids = [file.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([(file.id_to_piece(i), i, -math.log(r + 1) - total) for i, r in rank.items()], byte_ids)

    def encode_segments(self, segments: list[str]) -> list[tuple[int, ...]]:
        """Best path of each segment, spaces standing for markers."""
        raw = [s.encode() for s in segments]
        out: list[tuple[int, ...]] = [()] * len(raw)
        for i, x in enumerate(raw):
            if len(x) > LONG:
                out[i] = self._long(x)
        order = sorted((i for i in range(len(raw)) if len(raw[i]) <= LONG), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order):
            # Texts of nearly one length share a table, of at most some million cells.
            longest, end = len(raw[order[at]]) * 5 // 4 + 4, at
            while end < len(order) and len(raw[order[end]]) <= longest and (end - at) * longest <= 1 << 20:
                end += 1
            end = max(end, at + 1)
            for i, path in zip(order[at:end], self._viterbi([raw[i] for i in order[at:end]]), strict=True):
                out[i] = path
            at = end
        return out

    def _viterbi(self, raw: list[bytes]) -> Iterator[tuple[int, ...]]:
        n, width = len(raw), max(map(len, raw))
        length = np.array([len(x) for x in raw])
        cells = np.frombuffer(b"".join(x.ljust(width + 4, b"\0") for x in raw), np.uint8).reshape(n, width + 4)
        best = np.full((n, width + 5), -np.inf)
        best[:, 0] = 0.0
        piece = np.full((n, width + 5), -1, np.int32)
        came = np.zeros((n, width + 5), np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            rows = np.flatnonzero((length > i) & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            lead = cells[rows, i]
            span = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(n, bool)
            live, state = rows, np.zeros(len(rows), np.int32)
            step = np.zeros(n, np.int64)
            step[rows] = span
            for d in range(i, min(width, i + self.trie.longest)):
                code = cells[live, d]
                nxt = base[state] + code
                good = (check[nxt] == state) & (length[live] > d) & (base[state] > 0)
                live, state = live[good], nxt[good]
                if not len(live):
                    break
                v = value[state]
                has = v >= 0
                if has.any():
                    r, v = live[has], v[has]
                    single[r[step[r] == d - i + 1]] = True
                    score = best[r, i] + self.scores[v]
                    better = score > best[r, d + 1]
                    r, v = r[better], v[better]
                    best[r, d + 1], piece[r, d + 1], came[r, d + 1] = score[better], v, i
            r = rows[~single[rows]]
            if len(r):
                to = i + step[r]
                score = best[r, i] + self.unknown
                better = score > best[r, to]
                r, to = r[better], to[better]
                best[r, to], piece[r, to], came[r, to] = score[better], -1, i
        for k in range(n):
            path: list[int] = []
            at = int(length[k])
            p, c = piece[k].tolist(), came[k].tolist()
            while at:
                start = c[at]
                if p[at] >= 0:
                    path.append(p[at])
                else:
                    path += self.byte_ids[list(raw[k][start:at][::-1])].tolist()
                at = start
            yield tuple(path[::-1])

    def _long(self, raw: bytes) -> tuple[int, ...]:
        """Best path of one segment, start by start."""
        if self._lists is None:
            self._lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()
        base, check, value, scores = self._lists
        n, low = len(raw), float("-inf")
        best, piece, came = [low] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == low:
                continue
            lead = raw[i]
            end = i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single, state = False, 0
            for d in range(i, n):
                if not base[state]:
                    break
                nxt = base[state] + raw[d]
                if check[nxt] != state:
                    break
                state, v = nxt, value[nxt]
                if v >= 0:
                    single |= d + 1 == end
                    score = here + scores[v]
                    if score > best[d + 1]:
                        best[d + 1], piece[d + 1], came[d + 1] = score, v, i
            if not single and here + self.unknown > best[end]:
                best[end], piece[end], came[end] = here + self.unknown, -1, i
        path: list[int] = []
        at = n
        while at:
            start = came[at]
            path += [piece[at]] if piece[at] >= 0 else self.byte_ids[list(raw[start:at][::-1])].tolist()
            at = start
        return tuple(path[::-1])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; an empty text has none, any other gets a leading marker.

        A literal U+2581 goes by its bytes, so that decoding is exact for all texts.
        """
        cut = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(chain.from_iterable(cut)) - self.known.keys())
        plain = [s for s in new if s != MARKER]
        self.known.update(zip(plain, self.encode_segments(plain), strict=True))
        self.known[MARKER] = tuple(self.byte_ids[list(MARKER.encode())].tolist())
        find = self.known.__getitem__
        out = [list(chain.from_iterable(map(find, segments))) for segments in cut]
        for s in plain:
            if len(s) > LONG // 4:
                del self.known[s]
        return out

    def decode(self, ids) -> str:
        """The text of `ids`: markers become spaces, runs of byte pieces characters, and the leading marker goes."""
        piece = self.bytes
        out = b"".join([piece[i] for i in ids])
        return (out[1:] if out[:1] == b" " else out).decode(errors="replace")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel.load(path)


def encode(docs: DataFrame, model_path: str = f"{FOLDER}/{MODEL}", verify: bool = False) -> DataFrame:
    """`docs` with a column ids (array<int>) from the whole text; null and empty texts have no ids.

    verify: also a column round_trip, whether decoding gives the text again.
    The new columns take the place of columns of these names.
    """

    def run(text: pa.Array) -> list:
        m = model(model_path)
        texts = [t.as_py() or "" for t in text]
        ids = m.encode(texts)
        off = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=off[1:])
        flat = np.fromiter(chain.from_iterable(ids), np.int32, off[-1])
        same = [pa.array([m.decode(i) == t for i, t in zip(ids, texts, strict=True)], pa.bool_())] if verify else []
        return [pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), *same]

    new = "ids array<int>" + (", round_trip boolean" if verify else "")
    return rows.spread(rows.added(docs, ["text"], new, run, 1 << 19), docs.columns, rows.names_of(new))


def decode(coded: DataFrame, model_path: str = f"{FOLDER}/{MODEL}") -> DataFrame:
    """`coded` with a column decoded from ids, in place of one of that name; null ids give null."""

    def run(ids: pa.Array) -> list:
        m = model(model_path)
        return [pa.array([m.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in ids], pa.string())]

    return rows.spread(rows.added(coded, ["ids"], "decoded string", run), coded.columns, ["decoded"])


def op3_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, verify=True).select("doc_id", "ids", F.size("ids").alias("n_tokens"), "round_trip")
