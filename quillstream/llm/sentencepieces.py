"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is cut where no piece can reach across (before a blank that follows a visible
character) and its distinct segments are concatenated.  A suffix array over the concatenation,
sorted to the length of the longest piece, is binary-searched for all pieces at once; every
occurrence becomes an edge (position, length, rank).  The edges, sorted by position, are relaxed: in
each segment the adjacent pair whose joint edge has the best score is merged, the leftmost first
among equals, until no pair has an edge.  That is the result of the BPE models' own encoder.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, ragged_parts, slices
from .tokens import mix

_BLANK = "▁"
_NO_EDGE = np.int64(1) << 40
_LONGEST = 64
#: Symbols matched and relaxed at a time, and characters of one text encoded at a time, about.
_GROUP = 1 << 18
_PIECE = 1 << 19


@dataclass
class PieceModel:
    """A BPE vocabulary: pieces that text can match, byte pieces, and the unknown piece."""

    pieces: dict[str, int]
    rank: np.ndarray
    bytes_: np.ndarray
    unknown: int
    dummy_prefix: bool
    texts: list[bytes]
    memo_bytes: int = 16 << 20

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """From a model file; a bare file name is one of the public tokenizers."""
        from sentencepiece import sentencepiece_model_pb2

        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only BPE models without normalisation are read")
        normal = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        score = np.array([p.score for p in proto.pieces])
        order = np.unique(-score, return_inverse=True)[1]
        raw = np.full(256, proto.trainer_spec.unk_id)
        texts = []
        for k, p in enumerate(proto.pieces):
            if p.type == p.BYTE:
                raw[int(p.piece[1:-1], 16)] = k
                texts.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                texts.append(p.piece.replace(_BLANK, " ").encode() if p.type == p.NORMAL else b"" if p.type == p.CONTROL else proto.trainer_spec.unk_surface.encode())
        return cls(normal, order, raw, proto.trainer_spec.unk_id, proto.normalizer_spec.add_dummy_prefix, texts)

    def __post_init__(self):
        self.longest = max(map(len, self.pieces))
        if self.longest >= _LONGEST or len(self.texts) > 1 << 26:
            raise ValueError(f"pieces of {_LONGEST} characters or more, or over 2**26 of them, do not fit an edge")
        none = np.zeros(0, np.int64)
        self.memo = Memo(none.astype(np.uint64), none, none, none.astype(np.int32), none, none, none.astype(np.uint32))
        chars = sorted({c for p in self.pieces for c in p})
        #: Symbols: 0 ends a segment, 1 is a character of no piece, then the characters of pieces.
        self.symbol = np.ones(0x110000, np.uint16)
        self.symbol[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        self.words = -(-self.longest // 4)
        names = list(self.pieces)
        self.piece_id = np.array([self.pieces[p] for p in names])
        self.piece_len = np.array([len(p) for p in names])
        codes = np.zeros((len(names), 4 * self.words), np.uint64)
        for k, p in enumerate(names):
            codes[k, : len(p)] = self.symbol[[ord(c) for c in p]]
        ends = codes.copy()
        ends[np.arange(codes.shape[1])[None, :] >= self.piece_len[:, None]] = 0xFFFF
        self.low, self.high = (_words(c) for c in (codes, ends))
        blank = ord(_BLANK)
        #: Whether cutting before a blank after a visible character changes nothing.
        self.cuts = not any(ord(p[k]) == blank and ord(p[k - 1]) != blank for p in names for k in range(1, len(p)))


def _words(codes: np.ndarray) -> np.ndarray:
    """Rows of 16-bit symbols as 64-bit words that compare in the same order."""
    c = codes.astype(np.uint64).reshape(len(codes), -1, 4)
    return c[:, :, 0] << np.uint64(48) | c[:, :, 1] << np.uint64(32) | c[:, :, 2] << np.uint64(16) | c[:, :, 3]


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the `depth` symbols that start there, `depth` a power of two of 4 at least (doubling)."""
    n = len(symbols)
    x = np.concatenate((symbols, np.zeros(4, symbols.dtype))).astype(np.uint64)
    key = x[:n] << np.uint64(48) | x[1 : n + 1] << np.uint64(32) | x[2 : n + 2] << np.uint64(16) | x[3 : n + 3]
    size = 4
    while True:
        order = np.argsort(key)
        if size >= depth:
            return order
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([True], ranked[1:] != ranked[:-1]))).astype(np.uint64)
        after = np.zeros(n, np.uint64)
        if size < n:
            after[: n - size] = rank[size:]
        key = rank << np.uint64(32) | after
        size *= 2


def _search(words: list[np.ndarray], order: np.ndarray, wanted: np.ndarray, past: bool) -> np.ndarray:
    """For each row of words, how many suffixes sort before it (or, with past, not after it)."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = order[np.minimum(mid, len(order) - 1)]
        less, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for k, w in enumerate(words):
            value = w[at]
            less |= same & (value < wanted[:, k])
            same &= value == wanted[:, k]
        go = (less | same if past else less) & open_
        low = np.where(go, mid + 1, low)
        high = np.where(open_ & ~go, mid, high)
    return low


def match_edges(symbols: np.ndarray, model: PieceModel) -> np.ndarray:
    """All occurrences of pieces as sorted rows (position, length, piece) packed in 64 bits: 32, 6 and 26."""
    n, depth = len(symbols), 4
    while depth < model.longest:
        depth *= 2
    order = suffix_array(symbols, depth)
    x = np.concatenate((symbols, np.zeros(4 * model.words, symbols.dtype))).astype(np.uint64)
    four = x[:-3] << np.uint64(48) | x[1:-2] << np.uint64(32) | x[2:-1] << np.uint64(16) | x[3:]
    words = [four[4 * k : 4 * k + n] for k in range(model.words)]
    low, high = _search(words, order, model.low, False), _search(words, order, model.high, True)
    count = high - low
    take = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    which = np.repeat(np.arange(len(count)), count)
    return np.sort(order[take].astype(np.uint64) << np.uint64(32) | model.piece_len[which].astype(np.uint64) << np.uint64(26) | model.piece_id[which].astype(np.uint64))


def relax(edges: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Merges symbols over the edges; (position, length) of the tokens of all segments, in order of position."""
    table = np.full((n, model.longest + 1), -1, np.int32)
    table[(edges >> np.uint64(32)).astype(np.int64), (edges >> np.uint64(26) & np.uint64(63)).astype(np.int64)] = (edges & np.uint64((1 << 26) - 1)).astype(np.int32)

    def score(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        piece = table[at, np.minimum(length, model.longest)]
        return np.where((length <= model.longest) & (piece >= 0), model.rank[piece], _NO_EDGE)

    done: list[tuple[np.ndarray, np.ndarray]] = []
    for s, m in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        done.append(_relax_long(table, s, m, model))
    short = sizes <= 64
    begin, size = starts[short], sizes[short]
    first = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(begin - first[:-1], size) + np.arange(first[-1])
    length = np.ones(len(at), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    while len(at):
        pair = np.full(len(at), _NO_EDGE)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair[inner] = score(at[inner], length[inner] + length[inner + 1])
        heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        best = np.minimum.reduceat(pair, heads)
        runs = np.diff(np.append(heads, len(at)))
        alive = np.repeat(best < _NO_EDGE, runs)
        done.append((at[~alive], length[~alive]))
        hit = np.flatnonzero((pair == np.repeat(best, runs)) & alive)
        hit = hit[np.concatenate(([True], owner[hit][1:] != owner[hit][:-1]))] if len(hit) else hit
        length[hit] += length[hit + 1]
        alive[hit + 1] = False
        at, length, owner = at[alive], length[alive], owner[alive]
    at, length = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(at)
    at, length = at[order], length[order]
    return at, np.where(table[at, length] >= 0, table[at, length], -1) if len(at) else length


def _relax_long(table: np.ndarray, start: int, size: int, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long segment, with a heap: n log n instead of a round for each merge."""
    length = [1] * size
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    gone = bytearray(size)
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < size and (total := length[i] + length[j]) <= model.longest and (piece := table[start + i, total]) >= 0:
            heapq.heappush(heap, (int(model.rank[piece]), i, total))

    for i in range(size):
        push(i)
    while heap:
        _, i, total = heapq.heappop(heap)
        if gone[i] or after[i] >= size or length[i] + length[after[i]] != total:
            continue
        j = after[i]
        gone[j] = 1
        length[i], after[i] = total, after[j]
        if after[j] < size:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    keep = [i for i in range(size) if not gone[i]]
    return np.array(keep, np.int64) + start, np.array([length[i] for i in keep], np.int64)


def encode_batch(texts: list[str | None], model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, and row offsets.  Null and empty texts have none.

    A long text is encoded in parts, cut where no piece reaches across."""
    full, parts = [], [0]
    for t in texts:
        full += _cut((_BLANK if model.dummy_prefix else "") + t.replace(" ", _BLANK), model) if t else []
        parts.append(len(full))
    done, sizes = [np.zeros(0, np.int32)], []
    a = 0
    while a < len(full):
        b, total = a, 0
        while b < len(full) and (b == a or total + len(full[b]) <= 2 * _PIECE):
            total += len(full[b])
            b += 1
        ids, ptr = _encode_parts(full[a:b], model)
        done.append(ids)
        sizes += np.diff(ptr).tolist()
        a = b
    return np.concatenate(done), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)[parts]


def _cut(text: str, model: PieceModel) -> list[str]:
    """Parts of about _PIECE characters, each from a blank that follows a visible character on; a text without one stays whole."""
    out, a = [], 0
    while model.cuts and len(text) - a > _PIECE:
        b = a + _PIECE
        while 0 < b < len(text) and not (text[b] == _BLANK and text[b - 1] != _BLANK):
            b = text.find(_BLANK, b + 1)
        if not 0 < b < len(text):
            break
        out.append(text[a:b])
        a = b
    return [*out, text[a:]]


def _encode_parts(full: list[str], model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all parts, none empty, and offsets."""
    points = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in full])
    blank = points == ord(_BLANK)
    cut = np.zeros(len(points), bool)
    cut[0] = True
    cut[ends[:-1]] = True
    if model.cuts:
        cut[1:] |= blank[1:] & ~blank[:-1]
    seg = np.flatnonzero(cut)
    size = np.diff(np.append(seg, len(points)))
    # Equal segments are matched once, and those met before not again; names only propose, the characters decide.
    name, sample, which = np.unique(_segment_hashes(points, seg, size), return_index=True, return_inverse=True)
    same = _equal(points, seg, size, points, seg[sample[which]], size[sample[which]])
    odd = np.flatnonzero(~same)  # of the name of another segment: matched each by itself
    which[odd] = len(name) + np.arange(len(odd))
    sample = np.concatenate((sample, odd))
    memo = model.memo
    known, place = np.zeros(len(sample), bool), np.zeros(len(sample), np.int64)
    if len(memo.names):
        place[: len(name)] = np.minimum(np.searchsorted(memo.names, name), len(memo.names) - 1)
        hit = np.flatnonzero(memo.names[place[: len(name)]] == name)
        at = place[hit]
        known[hit] = _equal(points, seg[sample[hit]], size[sample[hit]], memo.points, memo.starts[at], memo.sizes[at])
    fresh = sample[~known]
    new_ids, new_ptr = _encode_segments(points, seg[fresh], size[fresh], model)
    flat = np.concatenate((memo.ids, new_ids))
    begin, count = np.empty(len(sample), np.int64), np.empty(len(sample), np.int64)
    begin[known], count[known] = memo.begin[place[known]], memo.count[place[known]]
    begin[~known], count[~known] = new_ptr[:-1] + len(memo.ids), np.diff(new_ptr)
    out = flat[_ranges(begin[which], count[which])]
    total = np.concatenate(([0], np.cumsum(count[which])))
    offsets = np.concatenate(([0], total[np.searchsorted(seg, ends)]))
    named = np.flatnonzero(~known[: len(name)])
    if len(memo.names):
        named = named[memo.names[place[named]] != name[named]]
    rank = np.cumsum(~known) - 1  # among the fresh ones
    memo.add(name[named], points, seg[sample[named]], size[sample[named]], new_ids, new_ptr[rank[named]], np.diff(new_ptr)[rank[named]], model.memo_bytes)
    return out, offsets


def _equal(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Which of the ranges of two arrays hold the same values."""
    out = a_size == b_size
    at = np.flatnonzero(out & (a_size > 0))
    differ = a[_ranges(a_start[at], a_size[at])] != b[_ranges(b_start[at], a_size[at])]
    if len(at):
        out[at] = ~np.logical_or.reduceat(differ, np.concatenate(([0], np.cumsum(a_size[at])[:-1])))
    return out


_code_of: list[np.ndarray] = []


def _segment_hashes(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every segment of code points."""
    if not _code_of:
        _code_of.append(np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    within = np.arange(len(points)) - np.repeat(start, size)
    power = np.multiply.accumulate(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    return mix(np.add.reduceat(_code_of[0][points] * power[within], start) + size.astype(np.uint64))


@dataclass
class Memo:
    """Tokens of segments met before, with the segments: the first met, up to a number of bytes."""

    names: np.ndarray
    begin: np.ndarray
    count: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    points: np.ndarray

    def add(self, names: np.ndarray, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, begin: np.ndarray, count: np.ndarray, limit: int) -> None:
        held = 40 * len(self.names) + 4 * len(self.ids) + 4 * len(self.points)
        few = np.flatnonzero(held + np.cumsum(40 + 4 * sizes + 4 * count) <= limit)
        if not len(few):
            return
        names, starts, sizes, begin, count = names[few], starts[few], sizes[few], begin[few], count[few]
        every = np.concatenate((self.names, names))
        order = np.argsort(every, kind="stable")
        after = lambda n, base: np.concatenate(([0], np.cumsum(n)[:-1])) + base
        self.begin = np.concatenate((self.begin, after(count, len(self.ids))))[order]
        self.count = np.concatenate((self.count, count))[order]
        self.starts = np.concatenate((self.starts, after(sizes, len(self.points))))[order]
        self.sizes = np.concatenate((self.sizes, sizes))[order]
        self.names, self.ids = every[order], np.concatenate((self.ids, ids[_ranges(begin, count)]))
        self.points = np.concatenate((self.points, points[_ranges(starts, sizes)]))


def _encode_segments(points: np.ndarray, begin: np.ndarray, size: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of some segments of the points, and offsets into them; about _GROUP symbols at a time."""
    groups = np.searchsorted((np.cumsum(size + 1) - 1) // _GROUP, np.arange((size + 1).sum() // _GROUP + 2))
    done, counts = [np.zeros(0, np.int32)], []
    for a, b in zip(groups, groups[1:], strict=False):
        if a < b:
            ids, ptr = _encode_group(points, begin[a:b], size[a:b], model)
            done.append(ids)
            counts.append(np.diff(ptr))
    return np.concatenate(done), np.concatenate(([0], np.cumsum(np.concatenate(counts)) if counts else [])).astype(np.int64)


def _encode_group(points: np.ndarray, begin: np.ndarray, size: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    text = np.zeros(int((size + 1).sum()), np.uint32)
    text[_ranges(start, size)] = points[_ranges(begin, size)]
    symbols = model.symbol[text]
    symbols[start + size] = 0
    at, piece = relax(match_edges(symbols, model), start, size, len(symbols), model)
    # Characters of no piece become their bytes.
    count = np.ones(len(at), np.int64)
    spelled = {}
    for k in np.flatnonzero(piece < 0).tolist():
        spelled[k] = model.bytes_[np.frombuffer(chr(text[at[k]]).encode("utf-8", "surrogatepass"), np.uint8)]
        count[k] = len(spelled[k])
    place = np.concatenate(([0], np.cumsum(count)))
    ids = np.empty(place[-1], np.int32)
    ids[place[:-1]] = piece
    for k, v in spelled.items():
        ids[place[k] : place[k + 1]] = v
    return ids, place[np.append(np.searchsorted(at, start), len(at))]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def decode_batch(ids: np.ndarray, ptr: np.ndarray, model: PieceModel) -> list[str]:
    """The texts of rows of token ids; bytes that are not UTF-8 become U+FFFD."""
    out = []
    texts = model.texts
    for a, b in zip(ptr.tolist(), ptr[1:].tolist(), strict=False):
        text = b"".join([texts[k] for k in ids[a:b].tolist()])
        if model.dummy_prefix and text[:1] == b" ":
            text = text[1:]
        out.append(text.decode("utf-8", "replace"))
    return out


_models: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel.load(path)
    return _models[path]


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", text_col: str = "text") -> DataFrame:
    """The same rows with `tokens`, the ids of the whole text.

    Defined cases: a null or empty text has no tokens; all other columns are kept, and one called
    tokens is replaced; repeated rows are encoded alike; a long text is encoded in parts, cut at blanks, and one without a
    blank whole, which takes memory in proportion to it (see README); an empty table gives no rows.
    """
    base = docs.drop("tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, 1 << 20):
                ids, ptr = encode_batch(batch.column(text_col).to_pylist(), _model(model))
                tokens = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*batch.columns, tokens], names=[*batch.schema.names, "tokens"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("tokens", T.ArrayType(T.IntegerType()))]))


def decode_documents(rows: DataFrame, model: str = "piece_bpe_32k.model", tokens_col: str = "tokens") -> DataFrame:
    """The same rows with `decoded`, the text of the tokens; null tokens count as none."""
    base = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ptr = ragged_parts(batch.column(tokens_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decode_batch(ids, ptr, _model(model)), pa.string())], names=[*batch.schema.names, "decoded"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("decoded", T.StringType())]))


def encode_digests(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, tokens (the ids), n_tokens, n_bytes (byte pieces among them), tokens_md5 (of the ids as 32-bit
    little-endian integers) and round_trip (decoding gives the text; a null text counts as empty).

    Encoding and decoding run in one pass, so that the ids are not moved.  Defined cases as in encode_documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts, own = batch.column("text").to_pylist(), _model(model)
                ids, ptr = encode_batch(texts, own)
                decoded = decode_batch(ids, ptr, own)
                is_byte = np.zeros(len(own.texts), bool)
                is_byte[own.bytes_] = True
                spelled = np.concatenate(([0], np.cumsum(is_byte[ids])))[ptr]
                digests = [hashlib.md5(ids[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(ptr, ptr[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), ragged(pa.array(ids), ptr), pa.array(np.diff(ptr)), pa.array(np.diff(spelled)), pa.array(digests), pa.array([(t or "") == d for t, d in zip(texts, decoded, strict=True)])],
                    names=["id", "tokens", "n_tokens", "n_bytes", "tokens_md5", "round_trip"],
                )

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, tokens array<int>, n_tokens long, n_bytes long, tokens_md5 string, round_trip boolean").withColumnRenamed("id", id_col)
