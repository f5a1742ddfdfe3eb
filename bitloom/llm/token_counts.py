"""Exact token counts of whole texts, huge ones by overlap resynchronisation.

A text above ``CHUNK`` characters is encoded in overlapping chunks with
offsets. The tokenizer first takes out added (special) tokens, then cuts the
text into pre-tokens from left to right, each chosen by looking from its start
to at most one character beyond its end, and encodes each on its own. So:

* a pre-token boundary of a chunk that started at a true boundary is true
  itself, if it is at least ``MARGIN`` characters from the chunk's cut-off end;
* from a boundary that is true and also a boundary of the next chunk, the next
  chunk is cut exactly as the whole text is.

Only tokens in the overlap are looked at. Chunks are spliced at such common boundaries inside the overlap. If there is
none, the overlap is doubled, in the end up to the rest of the text. The count
is that of encoding the whole text, in memory bounded by a chunk unless a text
has no boundary for longer than that.

Shorter texts are encoded whole. Where the tokenizer is a byte-level BPE whose
merges are in the order of its ids, and a text has only printable ASCII, common
white space and Latin letters, on whose classes all versions of Unicode agree,
they are counted by tiktoken over the ranks in the same .json file, which
applies the same rules three times as fast. The first ``GUARD`` of them in every
Arrow batch are counted by both, and a difference ends the job.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm._scratch import schema

CHUNK = 32_768
OVERLAP = 512
#: Characters at a chunk's end whose cuts may depend on what follows: more than the longest added token and the look-ahead.
MARGIN = 64
LIMIT = 1024
#: Characters encoded in one call, which bounds the memory of the encodings.
BATCH_CHARS = 262_144
#: Texts of each Arrow batch that are counted by tiktoken and by tokenizers.
GUARD = 8

_loaded: dict[str, object] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a .json file, without truncation or padding; once for each process."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        longest = max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
        if longest + 8 > MARGIN:
            raise ValueError("an added token is longer than the margin")
        _loaded[path] = tokenizer
    return _loaded[path]


def _starts(encoding, places) -> Iterator[tuple[int, int]]:
    """(start, tokens before it) of the pre-tokens that begin with the tokens numbered ``places``."""
    for i in places:
        if i == 0 or encoding.token_to_word(i) != encoding.token_to_word(i - 1):
            yield encoding.token_to_chars(i)[0], i


def spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[object, int, int, int]]:
    """(encoding of a chunk, its first token that counts, the one after its last, widenings on the way to the next) along a text."""
    # The current chunk is text[base:end]; from the true boundary ``splice`` on, after ``skipped`` of its tokens, it counts.
    base, end, splice, skipped = 0, min(len(text), chunk), 0, 0
    encoding = tokenizer.encode(text[base:end], add_special_tokens=False)
    while end < len(text):
        wide, common, widened = overlap, None, 0
        while common is None:
            at = max(splice, end - wide)
            stop = min(len(text), end + max(chunk, end - at))
            following = tokenizer.encode(text[at:stop], add_special_tokens=False)
            if at == splice:  # it starts at a true boundary and takes the place of the current chunk
                common = (splice, 0, skipped)
                break
            sure = {}
            for place, n in _starts(encoding, range(len(encoding) - 1, -1, -1)):
                if base + place < at:
                    break
                if base + place <= end - MARGIN:
                    sure[base + place] = n
            for place, n in _starts(following, range(len(following))):
                if at + place > end:
                    break
                if at + place in sure:
                    common = (at + place, n, sure[at + place])
                    break
            if common is None:
                wide *= 2
                widened += 1
        yield encoding, skipped, common[2], widened
        splice, skipped = common[:2]
        base, end, encoding = at, stop, following
    yield encoding, skipped, len(encoding), 0


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """(tokens, widenings) of a text by overlapping chunks."""
    total = widened = 0
    for _, first, after, widenings in spliced(tokenizer, text, chunk, overlap):
        total, widened = total + after - first, widened + widenings
    return total, widened


#: Texts in which no character's class is in doubt.
_PLAIN = re.compile("[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")


def ranked(tokenizer):
    """The tiktoken encoding of a byte-level BPE's own vocabulary, or None if its merges are not a ranking by id."""
    import tiktoken
    from public_tokenizers import PATTERN

    rules = json.loads(tokenizer.to_str())
    model, cut = rules["model"], rules["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if model.get("type", "BPE") != "BPE" or not plain or rules["normalizer"] or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    special = {t["content"]: t["id"] for t in rules["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"]):
        return None
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(vocab.get(m) != 256 + i for i, m in enumerate(merges)) or len(vocab) != 256 + len(merges):
        return None
    # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _agreed(tokenizer, fast, text: str) -> int:
    """The tokens of a text by both libraries."""
    counts = len(fast.encode(text, allowed_special="all")), len(tokenizer.encode(text, add_special_tokens=False))
    if counts[0] != counts[1]:
        raise ValueError(f"the ranks give {counts[0]} tokens and the library {counts[1]} for a text of {len(text)} characters")
    return counts[1]


def _count(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        fast = ranked(tokenizer)
        for batch in batches:
            sizes, counts, widenings = [], [0] * batch.num_rows, [0] * batch.num_rows
            held, chars, guarded = [], 0, 0

            def flush():
                for (j, _), encoding in zip(held, tokenizer.encode_batch_fast([t for _, t in held], add_special_tokens=False)):
                    counts[j] = len(encoding)

            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                if len(text) > chunk:
                    counts[i], widenings[i] = count_long(tokenizer, text, chunk, overlap)
                elif fast and _PLAIN.fullmatch(text):
                    guarded += 1
                    counts[i] = _agreed(tokenizer, fast, text) if guarded <= GUARD else len(fast.encode(text, allowed_special="all"))
                else:
                    held.append((i, text))
                    chars += len(text)
                    if chars > BATCH_CHARS:
                        flush()
                        held, chars = [], 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(widenings, pa.int32())], names=["doc_id", "n_bytes", "n_tokens", "widenings"]
            )

    return run


def count_tokens(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and widenings (of overlaps) for every row of ``docs``.

    ``path`` is a tokenizers .json file that each executor can open; by default
    the public 50k byte-level BPE. No special tokens are added; those written
    in a text are encoded as the library does by default. Null texts count as
    empty and have 0 tokens. Rows are handled one by one: nothing is shuffled,
    repeated rows and null ids come back as they are, other columns are ignored.
    """
    kind = schema([docs.schema["doc_id"]], "n_bytes bigint, n_tokens bigint, widenings int")
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_count(path or tokenizer_path(), chunk, overlap), kind)


def over_limit(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The contract's columns from the result of ``count_tokens``."""
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "widenings")
