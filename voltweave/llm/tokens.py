"""Token counts of sections by offset-mapped attribution.

A document is encoded once, whole. Byte-level tokens add up to the text's bytes, so the running sum of the tokens' byte
lengths gives every token's span, and counting lead bytes turns it into a character span. Sections (here lines, or any
increasing list of boundaries) are intervals over the same axis, and the interval join is one binary search per document.

The rule for a token that crosses boundaries: it belongs to the section that holds most of its bytes, the earlier one if
several hold as many (`largest`); or to the section of its first byte (`first`). Every token is counted once, so the
sections' counts add up to the document's.

Defined cases: null and empty texts have no token and one empty section; a text that ends with a line feed has no further
section after it; runs of white space may have any length; a lone special-token string in a text is ordinary text. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import os
import re
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.llm.common import bounded_batches, decode, scored, utf8

VOCABULARY = os.environ.get("VOLTWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: How byte-level BPE vocabularies of this family cut a text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Runs of white space (Unicode's, as the pattern takes it) that are cut out before encoding: the pattern's look-ahead backs up
#: through a run, which overflows the encoder's stack in very long ones.
LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The end of each token, in bytes."""
        ids: list[int] = []
        at = 0
        for m in LONG_RUN.finditer(text):
            # the pattern makes a run one piece, but leaves its last character to the word that follows
            end = m.end() - (m.end() < len(text))
            ids += self.encoding.encode_ordinary(text[at : m.start()])
            ids += self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        ids += self.encoding.encode_ordinary(text[at:])
        return np.cumsum(self.lengths[np.asarray(ids, np.int64)])


def line_ends(data: bytes) -> np.ndarray:
    """The end of each line, in bytes, its line feed included."""
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return cuts if len(cuts) and cuts[-1] == len(data) else np.append(cuts, len(data))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and which tokens cross a boundary."""
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    owner = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    crossing = np.flatnonzero(last > owner)
    if rule == "largest":
        for t in crossing.tolist():
            cuts = np.concatenate(([starts[t]], section_ends[owner[t] : last[t]], [token_ends[t]]))
            owner[t] += int(np.diff(cuts).argmax())
    return np.bincount(owner, minlength=len(section_ends)), crossing


FIELDS = "n_bytes long, n_chars long, n_tokens long, n_sections long, n_crossing long, first_crossing long, section_tokens array<int>"


def token_record(encoder: Encoder, data: bytes, rule: str = "largest") -> tuple:
    """first_crossing: the character at which the first boundary-crossing token starts, else null."""
    text = decode(data)
    data = text.encode()
    ends = encoder.ends(text)
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    counts, crossing = attribute(ends, line_ends(data), rule)
    first = None
    if len(crossing):
        at = int(ends[crossing[0] - 1]) if crossing[0] else 0
        first = int(lead[:at].sum())
    return len(data), int(lead.sum()), len(ends), len(counts), len(crossing), first, counts.astype(np.int32)


def token_counts(spark: SparkSession, text: Column, path: str = VOCABULARY, rule: str = "largest") -> Column:
    """The vocabulary, about 50,000 entries, is read by the driver and sent to the executors."""
    shared = spark.sparkContext.broadcast(load_ranks(path))
    held: list[Encoder] = []
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Encoder(shared.value))
        out = pd.DataFrame([token_record(held[0], bytes(t), rule) for t in texts], columns=names)
        return out.astype({"first_crossing": "Int64"})

    return scored(FIELDS, run)(utf8(text))


def query(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    return docs.select("doc_id", token_counts(spark, F.col("text"), path).alias("_t")).select("doc_id", "_t.*")
