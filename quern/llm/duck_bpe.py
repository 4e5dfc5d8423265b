"""Byte-level BPE by recursive DuckDB queries: token-position rows meet the merge table until nothing merges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bpe, common

#: Pieces of more bytes than this are contracted by LONG, which keeps one state a word.
SHORT = 64

#: Words that are a token as they stand: the vocabulary is a table like any other.
WHOLE = "SELECT word, id FROM words JOIN vocabulary USING (bytes) ORDER BY word"

#: A row per word, position and step; each step contracts every word's leftmost pair of least rank, which
#: is the least of rank, position and next position as one number. A word without such a pair has no
#: row in the next step. npos and ntok are the next token's; pair is both tokens of a merge as one number.
CONTRACT = """
WITH RECURSIVE t(step, word, pos, tok, npos, ntok) AS (
  SELECT 0::INT, word, pos, tok, npos, ntok FROM positions
  UNION ALL
  (WITH best AS (
     SELECT word, min((rank::BIGINT << 40) | (pos::BIGINT << 20) | npos) AS least
     FROM t JOIN merges ON pair = ((tok::BIGINT << 32) | ntok) GROUP BY word),
   hit AS (
     SELECT best.word, (least >> 40)::INT AS rank, ((least >> 20) & 1048575)::INT AS pos, (least & 1048575)::INT AS gone, t.npos AS after, t.ntok AS after_tok
     FROM best JOIN t ON t.word = best.word AND t.pos = (least & 1048575))
   SELECT step + 1, t.word, t.pos,
          CASE WHEN t.pos = hit.pos THEN rank ELSE tok END,
          CASE WHEN t.pos = hit.pos THEN after ELSE npos END,
          CASE WHEN t.pos = hit.pos THEN after_tok WHEN npos = hit.pos THEN rank ELSE ntok END
   FROM t JOIN hit ON t.word = hit.word WHERE t.pos <> hit.gone)
)
SELECT word, pos, tok FROM t SEMI JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) last ON t.word = last.word AND t.step = last.step ORDER BY word, pos
"""

#: One state per word and position, replaced in place; each step contracts every occurrence of a word's
#: pair of least rank, leftmost first (in a run of one token, every other). As a merged token only takes
#: part in later ranks, that is what contracting them one by one from the left gives.
LONG = """
WITH RECURSIVE t(word, pos, tok, npos, ntok) USING KEY (word, pos) AS (
  SELECT word, pos, tok, npos, ntok FROM positions
  UNION
  (WITH now AS (SELECT * FROM recurring.t WHERE tok >= 0),
   hit AS (SELECT word, pos, npos, rank FROM now JOIN merges ON pair = ((tok::BIGINT << 32) | ntok) WHERE ntok >= 0),
   least AS (SELECT * FROM hit QUALIFY rank = min(rank) OVER (PARTITION BY word)),
   run AS (SELECT *, CASE WHEN lag(npos) OVER (PARTITION BY word ORDER BY pos) = pos THEN 0 ELSE 1 END AS fresh FROM least),
   run_no AS (SELECT *, sum(fresh) OVER (PARTITION BY word ORDER BY pos) AS no FROM run),
   chosen AS (SELECT word, pos, npos AS gone, rank FROM run_no QUALIFY row_number() OVER (PARTITION BY word, no ORDER BY pos) % 2 = 1),
   whole AS (SELECT chosen.*, now.npos AS after, now.ntok AS after_tok FROM chosen JOIN now ON now.word = chosen.word AND now.pos = chosen.gone),
   changed AS (
     SELECT now.word, now.pos, coalesce(own.rank, now.tok) AS tok, coalesce(own.after, now.npos) AS npos, coalesce(own.after_tok, now.ntok) AS ntok, own.pos IS NOT NULL AS merged
     FROM now LEFT JOIN whole own ON own.word = now.word AND own.pos = now.pos)
   SELECT c.word, c.pos, c.tok, c.npos, CASE WHEN n.pos IS NOT NULL THEN n.rank ELSE c.ntok END
   FROM changed c LEFT JOIN whole n ON n.word = c.word AND n.pos = c.npos
   WHERE (c.merged OR n.pos IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM whole g WHERE g.word = c.word AND g.gone = c.pos)
   UNION ALL
   SELECT word, gone, -1, -1, -1 FROM whole)
)
SELECT word, pos, tok FROM t WHERE tok >= 0 ORDER BY word, pos
"""

#: The bytes of all words' tokens in order of word and position, and how many hexadecimal digits each token has.
DECODE = "SELECT string_agg(hex, '' ORDER BY word, pos) AS hex, list(length(hex) ORDER BY word, pos) AS sizes FROM ids JOIN vocabulary ON tok = id"


class DuckBpe:
    """Encodes and decodes words by DuckDB over one vocabulary; one connection with one thread."""

    def __init__(self, ranks: dict[bytes, int], memory_mb: int = 400):
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{memory_mb}MB"})
        splits = [(ranks.get(t[:k]), ranks.get(t[k:]), i) for t, i in ranks.items() for k in range(1, len(t))]
        splits = [s for s in splits if s[0] is not None and s[1] is not None]
        merges = pa.table({"pair": pa.array([l << 32 | r for l, r, _ in splits], pa.int64()), "rank": pa.array([i for _, _, i in splits], pa.int32())})
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks], pa.string()), "bytes": pa.array(ranks, pa.binary())})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("rows", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.con.unregister("rows")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def _query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.con.register(name, rows)
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister(name)

    def _merge(self, words: list[bytes], sql: str) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(raw)) - np.repeat(lengths.cumsum() - lengths, lengths)).astype(np.int32)
        last = pos + 1 == lengths[word]
        npos, ntok = np.where(last, -1, pos + 1).astype(np.int32), np.where(last, -1, np.append(raw[1:], -1)).astype(np.int32)
        out = self._query("positions", pa.table({"word": word, "pos": pos, "tok": raw, "npos": npos, "ntok": ntok}), sql)
        ends = np.append(np.flatnonzero(np.diff(out["word"].to_numpy())) + 1, out.num_rows) * 4
        tokens, ends = out["tok"].to_numpy().astype("<u4").tobytes(), ends.tolist()
        return [tokens[a:b] for a, b in zip([0, *ends], ends)]

    def encode_words(self, words: list[bytes], rows: int = 400_000) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit numbers; no word is empty. Words that are no token
        go through the recursive queries, about `rows` bytes of words at a time."""
        out: list = [None] * len(words)
        whole = self._query("words", pa.table({"word": pa.array(range(len(words)), pa.int32()), "bytes": pa.array(words, pa.binary())}), WHOLE)
        for i, token in zip(whole["word"].to_pylist(), whole["id"].to_pylist()):
            out[i] = token.to_bytes(4, "little")
        order = sorted((i for i, ids in enumerate(out) if ids is None), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            end, size = at, 0
            long = len(words[order[at]]) > SHORT
            while end < len(order) and (end == at or size + len(words[order[end]]) <= rows) and (len(words[order[end]]) > SHORT) == long:
                size += len(words[order[end]])
                end += 1
            group = order[at:end]
            for i, ids in zip(group, self._merge([words[i] for i in group], LONG if long else CONTRACT)):
                out[i] = ids
            at = end
        return out

    def decode_words(self, words: list[bytes], rows: int = 400_000) -> list[bytes]:
        """Bytes of each sequence of ids; an id that the vocabulary lacks is an error."""
        out: list[bytes] = []
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= 4 * rows):
                size += len(words[end])
                end += 1
            group = words[at:end]
            lengths = np.fromiter(map(len, group), np.int64, len(group)) // 4
            ids = np.frombuffer(b"".join(group), "<u4").astype(np.int64)
            if ids.size and (ids.max() >= 2**31 or self._query("asked", pa.table({"id": np.unique(ids)}), "SELECT 1 FROM asked ANTI JOIN vocabulary USING (id) LIMIT 1").num_rows):
                raise ValueError("an id is not in the vocabulary")
            word = np.repeat(np.arange(len(group), dtype=np.int32), lengths)
            pos = (np.arange(len(ids)) - np.repeat(lengths.cumsum() - lengths, lengths)).astype(np.int32)
            got = self._query("ids", pa.table({"word": word, "pos": pos, "tok": ids.astype(np.int32)}), DECODE)
            raw = bytes.fromhex(got["hex"][0].as_py() or "")
            sizes = got["sizes"].combine_chunks().flatten().to_numpy().astype(np.int64) // 2
            # Where each word's bytes end: after those of its last token.
            ends = np.concatenate([[0], sizes.cumsum()])[np.concatenate([[0], lengths.cumsum()])].tolist()
            out += [raw[a:b] for a, b in zip(ends, ends[1:])]
            at = end
        return out


class Codec:
    """Texts to ids and back. Chunks of a text (white space and what follows it) are coded once and
    kept, as are the pieces that the pattern splits them into; what is kept is bounded and thrown
    away together when the bound is reached."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_kept: int = 800_000):
        self.duck, self.max_kept = DuckBpe(ranks), max_kept
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.chunk_ids: dict[str, bytes] = {}
        self.chunk_back: dict[str, bytes] = {}
        self.piece_ids: dict[str, bytes] = {}
        self.piece_back: dict[str, bytes] = {}

    def code(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text: its ids as little-endian unsigned 32-bit numbers, and the bytes they decode to."""
        chunks = [bpe.CHUNK.findall(t) for t in texts]
        if len(self.chunk_ids) > self.max_kept or len(self.piece_ids) > self.max_kept:
            for kept in (self.chunk_ids, self.chunk_back, self.piece_ids, self.piece_back):
                kept.clear()
        new: set[str] = set()
        for own in chunks:
            new.update(own)
        self._learn([c for c in new if c not in self.chunk_ids])
        ids, back = self.chunk_ids.__getitem__, self.chunk_back.__getitem__
        return [(b"".join(map(ids, own)), b"".join(map(back, own))) for own in chunks]

    def _learn(self, chunks: list[str]) -> None:
        ids, back = self.piece_ids, self.piece_back
        pieces = list(map(self.split, chunks))
        new = list(set(chain.from_iterable(pieces)).difference(ids))
        found = self.duck.encode_words([p.encode("utf-8", "surrogatepass") for p in new])
        ids.update(zip(new, found))
        back.update(zip(new, self.duck.decode_words(found)))
        for chunk, own in zip(chunks, pieces):
            if len(own) == 1:
                self.chunk_ids[chunk], self.chunk_back[chunk] = ids[own[0]], back[own[0]]
            else:
                self.chunk_ids[chunk] = b"".join([ids[p] for p in own])
                self.chunk_back[chunk] = b"".join([back[p] for p in own])


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a process: Python workers are used again by later tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(bpe.tiktoken_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], batch_chars: int = 4_000_000) -> DataFrame:
    """The columns in keep, ids (array of bigint) and decoded (binary) of every whole text.

    Null counts as the empty text, which has no ids. A very long text is coded whole, with a batch to itself.
    Columns in keep may have any names but those added. Special strings are ordinary text. Repeated
    rows are each coded; an empty table gives no rows. Texts stay in their partition: nothing is shuffled.
    """
    return _run(docs, ranks_path, pattern, keep, batch_chars, False)


def digests(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], batch_chars: int = 4_000_000) -> DataFrame:
    """As encode_and_decode(), with n_tokens, ids_sha256 and decoded_sha256 in place of ids and bytes."""
    return _run(docs, ranks_path, pattern, keep, batch_chars, True)


def _run(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], batch_chars: int, digest: bool) -> DataFrame:
    from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType

    def rows_of(coded: list[tuple[bytes, bytes]]) -> list[pa.Array]:
        if digest:
            return [pa.array([len(a) // 4 for a, _ in coded], pa.int64()), *(pa.array([hashlib.sha256(x[k]).hexdigest() for x in coded], pa.string()) for k in (0, 1))]
        return [pa.array([np.frombuffer(a, "<u4").astype(np.int64) for a, _ in coded], pa.list_(pa.int64())), pa.array([b for _, b in coded], pa.binary())]

    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= batch_chars):
                    size += len(texts[end])
                    end += 1
                kept = [c.slice(at, end - at) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, *rows_of(own.code(texts[at:end]))], names=[*batch.schema.names[1:], *new])
                at = end

    schema = docs.select(*keep).schema
    for name, kind in zip(new, (LongType(), StringType(), StringType()) if digest else (ArrayType(LongType()), BinaryType())):
        schema = schema.add(name, kind)
    mine = common.free_names(docs.select(*keep), "_whole_text")[0]
    return docs.select(F.col("text").cast("string").alias(mine), *keep).mapInArrow(run, schema)
