"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import xxhash
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches
from .token_output import pieces

#: A line feed, or spaces with the word after them, or a word: no piece of the vocabulary reaches over these borders.
_CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_M1, _M2, _M3, _MASK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, (1 << 64) - 1


class Vocabulary:
    """Ranks and ids of a BPE model with byte fallback; a space stands for the model's space mark."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = [-1] * 256
        self.rank, self.id, self.data = {}, {}, [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.data[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                self.id[text], self.rank[text], self.data[i] = i, -model.get_score(i), text.encode()
        if -1 in self.bytes:
            raise ValueError("the model has no byte fallback")
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.id):
            raise ValueError("pieces reach over spaces or lines")
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        for text, i in self.id.items():
            if len(text) == 1:
                self.chars[ord(text)] = i
        # all (left, right) whose text together is a piece, as left * n + right, with the piece and its place by rank
        ranks = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        place = {text: ranks[r] for text, r in self.rank.items()}
        pairs = sorted((self.id[text[:k]] * n + self.id[text[k:]], i, place[text]) for text, i in self.id.items() for k in range(1, len(text)) if text[:k] in self.id and text[k:] in self.id)
        self.pairs, self.pair_id, self.pair_rank = (np.array(x, dtype=np.int64) for x in zip(*pairs))

    def segment(self, chunk: str, key: int, dropout: int) -> list[int]:
        """Ids of one chunk. Candidates come off an agenda by rank, then place; one is skipped where its hash is below dropout.

        The hash of a candidate is keyed by the chunk's key and the range that the merged piece covers. A skipped
        candidate doesn't return; the range can still become a piece's part by other merges. Characters that no merge
        covers and the vocabulary lacks become bytes.
        """
        n = len(chunk)
        rank = self.rank
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda = []
        for i in range(n - 1):
            if (r := rank.get(chunk[i : i + 2])) is not None:
                agenda.append((r, i, i + 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, j = heapq.heappop(agenda)
            if not alive[i]:
                continue
            m = end[i]
            if m >= j or m >= n or end[m] != j:  # one of the two parts is gone
                continue
            if dropout:
                h = ((key ^ (i * _M1) ^ (j * _M2)) * _M3) & _MASK
                h ^= h >> 33
                if ((h * _M1) & _MASK) >> 32 < dropout:
                    continue
            alive[m] = False
            end[i] = j
            if j < n:
                before[j] = i
                if (r := rank.get(chunk[i : end[j]])) is not None:
                    heapq.heappush(agenda, (r, i, end[j]))
            if (k := before[i]) >= 0 and (r := rank.get(chunk[k:j])) is not None:
                heapq.heappush(agenda, (r, k, j))
        out, i, get = [], 0, self.id.get
        while i < n:
            piece = chunk[i : end[i]]
            found = get(piece)
            if found is None:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(found)
            i = end[i]
        return out


    def segment_all(self, chunks: list[str], keys: list[int], dropout: int, most: int = 40, block: int = 1 << 15) -> list[bytes]:
        """segment() of many chunks, as bytes of ids: the agendas of a block of chunks are worked off side by side.

        In each round every chunk takes the first candidate of its agenda. Chunks over `most` characters, or with a
        character that the vocabulary lacks, go through segment().
        """
        out: list[bytes | None] = [None] * len(chunks)
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ids = self.chars[codes]
        ends = np.cumsum(sizes)
        odd = np.logical_or.reduceat(ids < 0, ends - sizes) | (sizes > most) if len(chunks) else np.empty(0, bool)
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.segment(chunks[i], keys[i], dropout), dtype=self.kind).tobytes()
        rest = np.flatnonzero(~odd)
        rest = rest[np.argsort(sizes[rest], kind="stable")]
        keys = np.array(keys, dtype=np.uint64)
        for i in range(0, len(rest), block):
            own = rest[i : i + block]
            flat, counts = self._side_by_side(ids, ends[own] - sizes[own], sizes[own], keys[own], dropout)
            data, at = flat.astype(self.kind).tobytes(), (np.concatenate(([0], np.cumsum(counts))) * self.kind.itemsize).tolist()
            for j, a, b in zip(own.tolist(), at, at[1:]):
                out[j] = data[a:b]
        return out

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of the pairs in self.pairs, -1 where the two don't merge."""
        want = left.astype(np.int64) * len(self.data) + right
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, at, -1)

    def _side_by_side(self, ids, starts, sizes, keys, dropout):
        w, width, never = len(sizes), int(sizes.max()), np.iinfo(np.int64).max
        place = np.arange(width)
        inside = place < sizes[:, None]
        sym = np.where(inside, ids[np.minimum(starts[:, None] + place, len(ids) - 1)], 0).astype(np.int64).ravel()
        ends = np.tile(place + 1, w)  # of the symbol that begins here
        before = np.tile(place - 1, w)
        alive = inside.ravel().copy()
        # a candidate's place on the agenda: rank, then position; `never` where there is none
        agenda = np.full((w, width), never, dtype=np.int64)
        result = np.zeros(w * width, dtype=np.int64)
        flat = agenda.ravel()

        def offer(rows, left, right_end, pair):
            """Puts the merges that begin at `left` and end at right_end on the agenda, but for those that are skipped."""
            good = pair >= 0
            if dropout:
                i, j = left.astype(np.uint64), right_end.astype(np.uint64)
                h = (keys[rows] ^ (i * np.uint64(_M1)) ^ (j * np.uint64(_M2))) * np.uint64(_M3)
                h ^= h >> np.uint64(33)
                good &= (h * np.uint64(_M1)) >> np.uint64(32) >= dropout
            at = rows * width + left
            flat[at] = np.where(good, self.pair_rank[pair] * width + left, never)
            result[at] = self.pair_id[pair]

        rows, left = np.nonzero(inside[:, 1:])
        at = rows * width + left
        offer(rows, left, left + 2, self._merged(sym[at], sym[at + 1]))
        rows = np.arange(w)
        while len(rows):
            left = agenda[rows].argmin(axis=1)
            go = flat[rows * width + left] < never
            rows, left = rows[go], left[go]
            if not len(rows):
                break
            at = rows * width + left
            middle = ends[at]
            gone = rows * width + middle
            sym[at], ends[at] = result[at], ends[gone]
            alive[gone], flat[gone] = False, never
            right = ends[at]
            more = right < sizes[rows]
            flat[at] = never
            r, a, e = rows[more], left[more], right[more]
            before[r * width + e] = a
            offer(r, a, ends[r * width + e], self._merged(sym[r * width + a], sym[r * width + e]))
            prior = before[at]
            more = prior >= 0
            r, a, e = rows[more], prior[more], right[more]
            offer(r, a, e, self._merged(sym[r * width + a], sym[at[more]]))
        return sym[alive], alive.reshape(w, width).sum(axis=1)


class Segmenter:
    """Encodes texts. Each place of a text has a key of its own: a hash of seed, document and number of the chunk.

    So a result depends on nothing but the document, its key and the seed. Only what no dropout touches is kept for the
    next place with the same chunk. What is kept is bounded, which doesn't change results.
    """

    def __init__(self, path: str, seed: int, dropout: float, most: int = 250_000):
        self.vocabulary = Vocabulary(path)
        self.seed, self.dropout, self.most = seed, int(dropout * (1 << 32)), most
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None], keys: list[str]) -> list[bytes]:
        found = [_CHUNK.findall(" " + text) if text else [] for text in texts]
        chunks = [c for own in found for c in own]
        if self.dropout:
            parts = []
            for own, key in zip(found, keys):
                h = (np.arange(len(own), dtype=np.uint64) * np.uint64(_M1)) ^ np.uint64(xxhash.xxh64_intdigest(key.encode(), seed=self.seed))
                h = (h ^ (h >> np.uint64(29))) * np.uint64(_M3)
                parts += (h ^ (h >> np.uint64(32))).tolist()
            got = self.vocabulary.segment_all(chunks, parts, self.dropout)
        else:
            if len(self.known) > self.most:
                self.known.clear()
            new = list({c for c in chunks if c not in self.known})
            self.known.update(zip(new, self.vocabulary.segment_all(new, [0] * len(new), 0)))
            got = [self.known[c] for c in chunks]
        ends = np.cumsum([len(own) for own in found]).tolist()
        return [b"".join(got[a:b]) for a, b in zip([0, *ends], ends)]

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of the text: the pieces' bytes, without the space put before it."""
        data = self.vocabulary.data
        return b"".join(map(data.__getitem__, np.frombuffer(ids, dtype=self.vocabulary.kind).tolist()))[1:]


_SEGMENTERS: dict[tuple, Segmenter] = {}


def segmenter(*args) -> Segmenter:
    """One for each worker process and set of parameters."""
    if args not in _SEGMENTERS:
        _SEGMENTERS[args] = Segmenter(*args)
    return _SEGMENTERS[args]


def encode(docs: DataFrame, model: str, seed: int = 42, dropout: float = 0.1, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, text_bytes, text_crc32, lossless) of each row, without a shuffle.

    The ids (array<int>; left out with keep=False) are decoded again at once: text_bytes and text_crc32 describe the decoded text and lossless
    says whether it equals the input byte for byte. dropout=0 gives the model's own segmentation. A null or empty text has
    no ids and decodes to the empty text. A literal space mark in a text is kept apart from a space by its bytes. Null
    ids hash as such; repeated rows give equal results; an empty table gives an empty result. Other columns are not read.
    """

    def each(batches):
        run = segmenter(model, seed, dropout)
        for batch in batches:
            for part in pieces(batch):
                out = {"ids": [], "n_tokens": [], "ids_crc32": [], "text_bytes": [], "text_crc32": [], "lossless": []}
                texts = part.column(1).to_pylist()
                for text, found in zip(texts, run.encode(texts, list(map(str, part.column(0).to_pylist())))):
                    ids = np.frombuffer(found, dtype=run.vocabulary.kind)
                    back = run.decode(found)
                    if keep:
                        out["ids"].append(ids.astype(np.int32))
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    out["text_bytes"].append(len(back))
                    out["text_crc32"].append(zlib.crc32(back))
                    out["lossless"].append(back == (text or "").encode())
                if not keep:
                    del out["ids"]
                columns = [pa.array(v, kinds[k]) for k, v in out.items()]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *out])

    kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_crc32": pa.int64(), "text_bytes": pa.int64(), "text_crc32": pa.int64(), "lossless": pa.bool_()}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + "ids array<int>, " * keep + "n_tokens long, ids_crc32 long, text_bytes long, text_crc32 long, lossless boolean"
    small_batches(docs.sparkSession)
    return rows.mapInArrow(frugal(each), schema)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """encoded with its ids decoded to a column `text`; null ids give null."""

    def each(batches):
        run = segmenter(model, 0, 0.0)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            texts = [None if x.as_py() is None else run.decode(np.array(x.as_py(), dtype=run.vocabulary.kind).tobytes()).decode() for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    from pyspark.sql.types import StringType, StructType

    rest = encoded.drop("text")
    return rest.mapInArrow(each, StructType([*rest.schema.fields]).add("text", StringType()))


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), keep=False)
