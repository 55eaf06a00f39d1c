"""Token counts with a whole-token shortcut.

Offline, on the driver, every vocabulary string that can stand for a whole pre-token is put through the ranked merges;
those that come out as one token are proved and counted by a lookup. Only other pre-tokens are merged. The vocabulary
bounds what is broadcast (about 50,000 strings and merges).

Nulls and empty texts have no tokens. Rows are kept one for one; other columns of the input don't matter.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, table, tidied

#: Pre-tokens whose counts a worker remembers; others are merged again each time.
REMEMBERED = 400_000
LIMIT = 2048


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def merged_size(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when pairs have been merged by least rank, leftmost first."""
    n = len(symbols)
    if n <= 24:
        symbols = list(symbols)
        while len(symbols) > 1:
            least, at = min([(ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:]))])
            if least == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return len(symbols)
    piece, nxt, prv, left = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), n
    heap = [(r, i, piece[i], piece[i + 1]) for i in range(n - 1) if (r := ranks.get((piece[i], piece[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if piece[i] != a or (j := nxt[i]) >= n or piece[j] != b:
            continue
        piece[i], piece[j], left = a + b, "", left - 1
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for x, y in ((i, nxt[i]), (prv[i], i)):
            if x >= 0 and y < n and (r := ranks.get((piece[x], piece[y]))) is not None:
                heapq.heappush(heap, (r, x, piece[x], piece[y]))
    return left


class Sizes(dict):
    """Tokens by pre-token: the proved strings, and what has been merged so far."""

    def __init__(self, proved: set[str], ranks: dict[tuple[str, str], int], suffix: str):
        super().__init__(dict.fromkeys(proved, 1))
        self.ranks, self.suffix, self.chars, self.most = ranks, suffix, byte_chars(), len(proved) + REMEMBERED

    def __missing__(self, word: str) -> int:
        symbols = [self.chars[b] for b in word.encode()]
        symbols[-1] += self.suffix
        n = merged_size(symbols, self.ranks)
        if len(self) < self.most:
            self[word] = n
        return n

    def __reduce__(self):
        return _sizes, ({w for w, n in self.items() if n == 1}, self.ranks, self.suffix)


def _sizes(proved: set[str], ranks: dict, suffix: str) -> Sizes:
    return Sizes(proved, ranks, suffix)


def load(path: str) -> dict:
    """Of a byte-level BPE file with word ends: ranks, word end, splitting pattern, special strings and proved strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, kinds = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not (split["invert"] and split["behavior"] == "Removed") or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: a kind of tokenizer that isn't supported")
    ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    suffix, by_char = model["end_of_word_suffix"], {c: b for b, c in enumerate(byte_chars())}
    proved = set()
    for word in model["vocab"]:
        body = word.removesuffix(suffix)
        if body and word != body and all(c in by_char for c in body) and merged_size([*body[:-1], body[-1] + suffix], ranks) == 1:
            try:
                proved.add(bytes(by_char[c] for c in body).decode())
            except UnicodeDecodeError:
                pass  # part of a character: never a whole pre-token
    return {"ranks": ranks, "suffix": suffix, "pattern": split["pattern"]["Regex"], "special": sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True), "proved": proved}


def normalise(text: str) -> str:
    """NFC and lower case, each character by itself (a final sigma is no exception); white space only separates."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each text."""
    spec = load(path)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Sizes(spec["proved"], spec["ranks"], spec["suffix"]))
    pattern, special = spec["pattern"], spec["special"]
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, find = shared.value.__getitem__, regex.compile(pattern).findall
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        for b in batches:
            counts = []
            for text in b.column(1).to_pylist():
                parts = cut.split(text or "") if cut else [text or ""]
                counts.append(len(parts) - 1 + sum([sum(map(sizes, find(normalise(p)))) for p in parts]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(tidied(run), "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count_tokens(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
