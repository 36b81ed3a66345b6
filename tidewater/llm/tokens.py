"""Token counts with overlap resynchronisation for huge texts.

Short texts are encoded in batches. A huge text is cut into overlapping chunks that are
encoded with offsets, and the counts are spliced in the overlaps.

Why a splice is exact: the tokenizer first looks for special strings, then cuts the text
into words by a scanner that runs from left to right and sees at most one character
beyond a word's end, and encodes each word by itself. Where the scan of the left chunk
and the scan of the right chunk both have a word boundary, they go on alike from there.
A boundary of the left chunk counts as proven only if it stands more than the longest
special string away from the cut, so the cut can't have caused it; a boundary of the
right chunk holds from there on because it is proven on the left. If an overlap has no
common boundary, the right chunk is widened to the left, and if all of it is used up the
two chunks are encoded as one.

Since words are encoded each by itself, a word's count holds wherever it stands. Given
the word pattern of the tokenizer file, short texts are cut into words here and only
words that a task hasn't met are encoded by the library, as texts of their own. That is
done only for texts whose characters have the same class in every Unicode version
(``SAFE``) and that hold no special string; all others are encoded whole.

Defined results: a null text counts as empty and has 0 bytes and tokens; repeated rows,
ties and null ids are counted each; texts of any length are counted whole, and memory
grows with a chunk, not with the text, unless no word ends in it; columns named n_bytes
and n_tokens are replaced, others pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Texts of more code points than HUGE are cut into chunks of CHUNK that overlap by OVERLAP.
HUGE, CHUNK, OVERLAP = 16384, 8192, 256
#: Code points encoded at once.
BATCH = 1 << 20
#: Words whose counts a task keeps; then it starts anew.
MEMO = 1 << 19
SAFE = r"[\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u024f]*"


def boundaries(encoding, start: int) -> dict[int, int]:
    """Where words begin: place in the text -> number of tokens before it in the chunk."""
    out, last = {}, None
    for i, (word, (a, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != last or word is None:
            out.setdefault(start + a, i)
        last = word
    return out


def spliced_count(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = 16) -> int:
    """Tokens of ``text``, encoded in chunks; ``margin`` is over the length of any special string."""
    at, total = 0, 0  # text[:at] is counted and ``at`` is a proven boundary
    size = chunk
    while True:
        end = min(len(text), at + size)
        left = encode(text[at:end])
        if end == len(text):
            return total + len(left.ids)
        proven = {p: n for p, n in boundaries(left, at).items() if at < p <= end - margin}
        wide = overlap
        while proven and wide <= size:
            begin = max(at, end - wide)
            right = encode(text[begin : min(len(text), end + wide)])
            common = [p for p in boundaries(right, begin) if p in proven and p > begin]
            if common:
                cut = max(common)
                total, at, size = total + proven[cut], cut, chunk
                break
            wide *= 2
        else:
            size *= 2  # no word ends in the whole chunk: encode more of the text at once


def word_memo(encode_all, pattern: str, specials: list[str]):
    """A function: texts -> counts, None for those to be encoded whole."""
    import regex

    words, safe, memo = regex.compile(pattern), regex.compile(SAFE), {}

    def counts(texts: list[str]) -> list[int | None]:
        if len(memo) > MEMO:
            memo.clear()
        cut = [None if safe.fullmatch(t) is None or any(s in t for s in specials) else words.findall(t) for t in texts]
        new = list({w for ws in cut if ws for w in ws if w not in memo})
        memo.update(zip(new, map(len, encode_all(new)), strict=True))
        return [None if ws is None else sum(map(memo.__getitem__, ws)) for ws in cut]

    return counts


def _counter(path: str, pattern: str | None, huge: int, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        margin = 2 + max(map(len, specials), default=0)
        one = lambda s: tokenizer.encode(s, add_special_tokens=False)
        many = lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        by_word = word_memo(many, pattern, specials) if pattern else lambda texts: [None] * len(texts)

        def group(texts: list[str]) -> list[int]:
            found = by_word(texts)
            left = [i for i, n in enumerate(found) if n is None]
            for i, e in zip(left, many([texts[i] for i in left]), strict=True):
                found[i] = len(e)
            return found

        for batch in batches:
            counts, held, size = [], [], 0
            for t in batch.column(batch.num_columns - 1).to_pylist():
                if len(t) > huge or size > BATCH:
                    counts, held, size = counts + group(held), [], 0
                if len(t) > huge:
                    counts.append(spliced_count(one, t, chunk, overlap, margin))
                else:
                    held.append(t)
                    size += len(t)
            counts += group(held)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def with_token_counts(
    docs: DataFrame, path: str, text: str = "text", pattern: str | None = None, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """The columns of ``docs`` but the text, with n_bytes and n_tokens.

    ``path``: a tokenizers file that each executor has; ``pattern``: its word pattern, if known.
    """
    own = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    t = text_or_empty(text)
    given = docs.select(*own, F.octet_length(t).cast("long").alias("n_bytes"), t.alias("tk_text"))
    schema = given.drop("tk_text").schema.add("n_tokens", "long")
    return given.mapInArrow(_counter(path, pattern, huge, chunk, overlap), schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = with_token_counts(docs, public_tokenizers.path(TOKENIZER), pattern=public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
