"""Byte-level BPE by prefix dynamic programming, and token counts.

For every byte prefix of a piece exactly one token can be the last one of the
prefix's encoding.  Token ``t`` ending at byte ``j`` is that token if the
prefix before it ends (in its own encoding) with a token ``s`` such that no
merge would ever cross the border between ``s`` and ``t``.  Storing the last
token per prefix gives the whole encoding by walking back, makes an append
cost only the new bytes, and lets an edit stop as soon as the stored tokens
agree again with the old ones.

Null texts count as empty: no ids, empty decoded bytes.  Pieces of any length
are handled in time linear in their bytes; repeated rows are encoded alike, null
ids are kept.  An empty table gives no row, of encodings or of lengths.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketlens.llm.common import map_text, read, written

_NO_LIMIT = 1 << 62


class BpeTable:
    """Ranks, token bytes and, per token, the two tokens it was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        n = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * n
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.left, self.right = list(range(n)), list(range(n))
        self._border: dict[int, bool] = {}
        # a token that no merge can make (only a whole piece can be it)
        self.unmade: set[int] = set()
        for rank, token in enumerate(self.tokens):
            if len(token) > 1:
                for cut in range(1, len(token)):
                    a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                    if a is not None and b is not None and a < rank and b < rank and self._holds(a, b, rank):
                        self.left[rank], self.right[rank] = a, b
                        break
                else:
                    self.unmade.add(rank)
        self.mergeable = {t: r for t, r in ranks.items() if r not in self.unmade}

    def _holds(self, a: int, b: int, limit: int = _NO_LIMIT) -> bool:
        """True if a merge never crosses the border between tokens a and b."""
        ranks, tokens, left, right = self.ranks, self.tokens, self.left, self.right
        while True:
            merged = ranks.get(tokens[a] + tokens[b])
            if merged is not None and merged < limit:
                return False
            # undo the later of the two merges next to the border
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def border(self, a: int, b: int) -> bool:
        key = a << 24 | b
        known = self._border.get(key)
        if known is None:
            if len(self._border) >= 600_000:
                self._border.clear()
            known = self._border[key] = self._holds(a, b)
        return known

    def last_token(self, data: bytes, j: int, last_of) -> int:
        """The last token of the prefix of ``j`` bytes; ``last_of(i)`` gives it for shorter ones."""
        get, border = self.mergeable.get, self._border.get
        for i in range(j - 1, max(-1, j - self.longest - 1), -1):
            token = get(data[i:j])
            if token is not None:
                if not i:
                    return token
                before = last_of(i)
                known = border(before << 24 | token)
                if known or known is None and self.border(before, token):
                    return token
        raise ValueError("a byte has no token of its own")

    def extend(self, data: bytes, last: list[int], start: int, stop: int) -> None:
        """Fill ``last[j]`` for start < j <= stop."""
        for j in range(start + 1, stop + 1):
            last[j] = self.last_token(data, j, last.__getitem__)

    def walk_back(self, last: list[int]) -> list[int]:
        ids, j, tokens = [], len(last) - 1, self.tokens
        while j > 0:
            ids.append(last[j])
            j -= len(tokens[last[j]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last = [0] * (len(piece) + 1)
        self.extend(piece, last, 0, len(piece))
        return self.walk_back(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixEncoding:
    """The encoding of one growing or edited byte string (without a split
    pattern): exact after every append and edit."""

    def __init__(self, table: BpeTable, data: bytes = b""):
        self.table, self.data, self.last = table, b"", [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        n = len(self.data)
        self.data += more
        self.last += [0] * len(more)
        self.table.extend(self.data, self.last, n, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start..stop; returns how many prefixes
        were computed anew.  Past the edit it stops once as many tokens in a
        row as the longest token has bytes agree with the stored ones."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start + 1] + [0] * len(new) + old[stop + 1:]
        n, same, j = len(self.data), 0, start
        while j < n:
            j += 1
            was = old[j - shift] if j > start + len(new) else None
            self.table.extend(self.data, self.last, j - 1, j)
            same = same + 1 if was == self.last[j] else 0
            if same >= self.table.longest:
                break
        return j - start

    def ids(self) -> list[int]:
        whole = self.table.ranks.get(self.data)
        return [whole] if whole is not None else self.table.walk_back(self.last)


class PrefixStore:
    """Last tokens of byte prefixes, shared by all pieces that begin alike.

    Most words of a corpus share their beginnings, so a new piece costs only
    its unseen prefixes.  Holds every prefix of what it holds; emptied when
    full, which bounds memory and changes no result.
    """

    def __init__(self, table: BpeTable, most: int = 400_000):
        self.table, self.most, self.last = table, most, {}

    def encode(self, piece: bytes) -> list[int]:
        table, last = self.table, self.last
        whole, n = table.ranks.get(piece), len(piece)
        if whole is not None:
            return [whole]
        if n > 64:
            return table.encode(piece)
        if len(last) > self.most:
            last.clear()
        j = n
        while j and piece[:j] not in last:
            j -= 1
        while j < n:
            j += 1
            last[piece[:j]] = table.last_token(piece, j, lambda i: last[piece[:i]])
        ids, tokens = [], table.tokens
        while j:
            token = last[piece[:j]]
            ids.append(token)
            j -= len(tokens[token])
        return ids[::-1]


class _Cache(dict):
    """text -> packed ids, in two generations so that memory stays bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        packed = self.old.get(key)
        if packed is None:
            packed = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = packed
        return packed


#: Cuts a text into runs that a space-led pattern never crosses, so that each
#: distinct run is split and encoded once.
CHUNKS = r" ?\S+|\s+(?!\S)|\s+"


class TextEncoder:
    """Text -> packed ids (little-endian unsigned 32-bit), as the split
    ``pattern`` and the ranks give them."""

    def __init__(self, table: BpeTable, pattern: str, chunks: str | None = None):
        import regex
        store = PrefixStore(table)
        split = regex.compile(pattern).findall
        piece = _Cache(lambda p: np.array(store.encode(p.encode()), dtype="<u4").tobytes(), 100_000).__getitem__
        self._plain = lambda text: b"".join(map(piece, split(text)))
        # these four count as white space to Python's \\s alone
        self._odd = re.compile("[\x1c-\x1f]").search
        self._chunk = chunks and re.compile(chunks).findall
        self._of_chunk = _Cache(self._plain, 200_000).__getitem__

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self._chunk or self._odd(text):
            return self._plain(text)
        return b"".join(map(self._of_chunk, self._chunk(text)))


@lru_cache(maxsize=2)
def load_table(path: str) -> BpeTable:
    """One table per worker process; ``path`` is a file that every machine has."""
    with open(path, "rb") as f:
        return BpeTable({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def text_encoder(path: str, pattern: str, chunks: str | None) -> TextEncoder:
    """An encoder whose stores live as long as a task, so that idle workers hold none."""
    return TextEncoder(load_table(path), pattern, chunks)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text",
                  keep: list[str] | None = None, chunks: str | None = None) -> DataFrame:
    """``keep`` columns (all but the text by default) plus ``n_tokens`` long,
    ``ids`` binary (little-endian unsigned 32-bit) and ``decoded`` binary.

    ``chunks`` is a coarser pattern whose matches ``pattern`` never crosses
    (:data:`CHUNKS` for space-led patterns); it saves time only.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep

    def make():
        table, encode = load_table(ranks_path), text_encoder(ranks_path, pattern, chunks)

        def fn(texts):
            packed = [encode(t) for t in texts]
            decoded = [table.decode(np.frombuffer(p, "<u4").tolist()) for p in packed]
            return [[len(p) // 4 for p in packed], packed, decoded]
        return fn

    return map_text(df, keep, text, [("n_tokens", "long"), ("ids", "binary"), ("decoded", "binary")], make)


def token_counts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text",
                 keep: list[str] | None = None, chunks: str | None = None) -> DataFrame:
    """``keep`` columns plus ``n_tokens``: the length of the encoding only."""
    keep = [c for c in df.columns if c != text] if keep is None else keep

    def make():
        encode = text_encoder(ranks_path, pattern, chunks)
        return lambda texts: [[len(encode(t)) // 4 for t in texts]]

    return map_text(df, keep, text, [("n_tokens", "long")], make)


def length_histogram(lengths: DataFrame, column: str = "n_tokens", block: int = 1024) -> DataFrame:
    """Exact histogram of document lengths with suffix sums; the histogram is
    written once, so the lengths are made once.

    One row per length that occurs: ``n_tokens``, ``n_docs``, ``docs_at_least``
    and ``tokens_at_least`` (documents at least this long, and their tokens),
    ``truncated_total`` (tokens left when every document is cut at this
    length), ``docs_at_most`` and ``quantile`` (share of documents up to this
    length).  Null lengths are left out; an empty input gives no rows.

    The suffix sums run over blocks of ``block`` lengths plus a sum per block,
    so no task sees the whole histogram.
    """
    h = (lengths.where(F.col(f"`{column}`").isNotNull())
         .groupBy(F.col(f"`{column}`").cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
         .withColumn("__b", F.floor(F.col("n_tokens") / block))
         .withColumn("__t", F.col("n_tokens") * F.col("n_docs")))
    h = written(h, "histogram")
    blocks = h.groupBy("__b").agg(F.sum("n_docs").alias("__bd"), F.sum("__t").alias("__bt"))
    up = W.orderBy(F.col("__b").desc())  # a row per block of lengths: a few hundred at most
    later, everything = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select("__b", F.coalesce(F.sum("__bd").over(later), F.lit(0)).alias("__ld"),
                           F.coalesce(F.sum("__bt").over(later), F.lit(0)).alias("__lt"),
                           F.sum("__bd").over(everything).alias("__docs"),
                           F.sum("__bt").over(everything).alias("__tokens"))
    within = W.partitionBy("__b").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, 0)
    s = (h.withColumn("__sd", F.sum("n_docs").over(within)).withColumn("__st", F.sum("__t").over(within))
         .join(blocks, "__b")
         .withColumn("docs_at_least", F.col("__sd") + F.col("__ld"))
         .withColumn("tokens_at_least", F.col("__st") + F.col("__lt"))
         .withColumn("docs_at_most", F.col("__docs") - F.col("docs_at_least") + F.col("n_docs")))
    return s.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
                    (F.col("__tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
                    .alias("truncated_total"),
                    "docs_at_most", (F.col("docs_at_most") / F.col("__docs")).alias("quantile"))


def context_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: ``documents``, ``truncated_docs`` (longer than
    the limit), ``total_tokens`` and ``kept_tokens`` (each document cut at the
    limit).  One pass over the histogram, no document is read again."""
    n, t = F.col("n_docs"), F.col("n_tokens")
    sums = [F.sum(F.when(t > x, n).otherwise(0)).alias(f"c{i}") for i, x in enumerate(limits)]
    sums += [F.sum(F.least(t, F.lit(x).cast("long")) * n).alias(f"k{i}") for i, x in enumerate(limits)]
    one = histogram.agg(F.sum(n).alias("d"), F.sum(t * n).alias("t"), *sums)
    rows = F.array(*[F.struct(F.lit(x).cast("long").alias("context_limit"), F.col("d").alias("documents"),
                              F.col(f"c{i}").alias("truncated_docs"), F.col("t").alias("total_tokens"),
                              F.col(f"k{i}").alias("kept_tokens")) for i, x in enumerate(limits)])
    return one.select(F.inline(rows))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The smallest length with at least a share ``q`` of the documents up to it."""
    return histogram.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _tokenizer()
    out = encode_decode(read(spark, sf_dir, "documents", "doc_id", "text"), path, pattern, chunks=CHUNKS)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _tokenizer()
    return length_histogram(token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), path, pattern, chunks=CHUNKS))
