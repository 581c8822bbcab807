"""Secret scans: fixed patterns, and strings that a tokenizer spends many tokens on.

Ordinary text, names and paths consist of pieces that a byte-pair vocabulary knows, so a token covers several characters;
random strings don't. A run of mixed characters with few characters per token is reported, unless it has the form of a
known digest or identifier, which are random but no secrets.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinewatch.llm.common import raw_bytes, rows_of

#: Kinds in the order in which spans of one start are listed.
ASSIGN, ACCESS, HEX, RANDOM = KINDS = ("assign", "access", "hex", "random")
#: The patterns and least lengths of the base kinds.
ASSIGNED = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS_KEY = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Least length of a run, and most characters per token of a random one.
LEAST_RUN, MOST_PER_TOKEN = 20, 2.0
#: Characters that one call to the tokenizer gets; a longer run is taken in pieces of so many.
PIECE = 4096
#: Digests are hexadecimal of these lengths (MD5, SHA-1, SHA-2 and SHA-3 families), or stand after their name.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST_NAME = re.compile(rb"(?i:md5|sha-?(?:1|224|256|384|512))[:=-]$")
UUID = re.compile(rb"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
ACCOUNT = re.compile(rb"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")

_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True

_vocabularies: dict[str, object] = {}


def vocabulary(path: str):
    """The encoding of a tiktoken file of ranks, once a worker."""
    if path not in _vocabularies:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _vocabularies[path] = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _vocabularies[path]


def _runs(flat: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of some bytes, from a least length on."""
    step = np.diff(member[flat].view(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = stop - start >= least
    return start[long], stop[long]


def mixed(run: bytes) -> bool:
    """Whether a run mixes letters with digits, or cases otherwise than a word does."""
    letters = re.sub(rb"[^A-Za-z]", b"", run)
    word = letters.islower() or letters.isupper() or letters[1:].islower()
    return bool(letters) and (not word or re.search(rb"[0-9]", run) is not None)


def known(run: bytes, before: bytes) -> bool:
    """Whether a run has the form of a digest or an identifier: UUID, or an account number whose check digits hold."""
    if len(run) in DIGEST_LENGTHS and re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", run) or DIGEST_NAME.search(before) or re.match(rb"(?i:md5|sha-?(?:1|224|256|384|512))-", run):
        return True
    if UUID.fullmatch(run):
        return True
    return bool(ACCOUNT.fullmatch(run)) and int("".join(str(int(chr(c), 36)) for c in run[4:] + run[:4])) % 97 == 1


def per_token(run: bytes, code) -> float:
    """Characters per token."""
    text = run.decode("ascii")
    return len(text) / sum(len(code.encode_ordinary(text[at : at + PIECE])) for at in range(0, len(text), PIECE))


def spans_of(column: pa.Array, code, least_run: int = LEAST_RUN, most_per_token: float = MOST_PER_TOKEN) -> tuple[np.ndarray, ...]:
    """Document number, kind, start and end (code points) of all spans, by document, start and kind."""
    data, offsets = raw_bytes(column)
    n = len(offsets) - 1
    flat = np.full(len(data) + n, 10, np.uint8)  # a line feed after each text: no pattern crosses it
    flat[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    ends = offsets[1:] + np.arange(n)
    raw = flat.tobytes()
    found = [(m.start(), m.end(), 0) for m in ASSIGNED.finditer(raw) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    found += [(m.start(), m.end(), 1) for m in ACCESS_KEY.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(a, b, 2) for a, b in zip(*(x.tolist() for x in _runs(flat, _HEX, LEAST_HEX)), strict=True)]
    base = np.array(sorted(found), np.int64).reshape(-1, 3)
    reach = np.maximum.accumulate(base[:, 1]) if len(base) else base[:, 1]
    for a, b in zip(*(x.tolist() for x in _runs(flat, _RUN, least_run)), strict=True):
        before = int(np.searchsorted(base[:, 0], b)) - 1  # base spans that start before the run ends
        if before >= 0 and reach[before] > a:
            continue  # reported already
        run = raw[a:b]
        if mixed(run) and not known(run, raw[max(0, a - 12) : a]) and per_token(run, code) <= most_per_token:
            found.append((a, b, 3))
    out = np.array(sorted((a, k, b) for a, b, k in found), np.int64).reshape(-1, 3)
    start, kind, stop = out[:, 0], out[:, 1], out[:, 2]
    doc = np.searchsorted(ends, start)
    first = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[doc] if n else start
    points = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    return doc, kind, points[start] - points[first], points[stop] - points[first]


def find_secrets(docs: DataFrame, ranks: str, least_run: int = LEAST_RUN, most_per_token: float = MOST_PER_TOKEN) -> DataFrame:
    """doc_id, text and spans (kind, start, stop in code points, stop exclusive), by start and then kind, of every row.

    Null text: empty, no spans. Texts of any length are looked at whole. Repeated rows and null ids are rows of their own.
    A run that overlaps a span of a fixed pattern isn't reported again. Empty table: empty result. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = vocabulary(ranks)
        for batch in rows_of(batches, "text", 1 << 21):
            doc, kind, start, stop = spans_of(batch.column("text"), code, least_run, most_per_token)
            spans = pa.StructArray.from_arrays([pa.array([KINDS[k] for k in kind.tolist()], pa.string()), pa.array(start), pa.array(stop)], names=["kind", "start", "stop"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), lists], names=["doc_id", "text", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, spans array<struct<kind: string, start: long, stop: long>>")


def mask(found: DataFrame, sign: str = "*") -> DataFrame:
    """doc_id and text with all characters of spans replaced, of find_secrets' rows."""
    pieces = F.transform(F.sequence(F.lit(0), F.size("spans") - 1), lambda i: F.struct(
        F.when(i == 0, F.lit(0)).otherwise(F.array_max(F.transform(F.slice("spans", 1, i), lambda s: s["stop"]))).alias("done"), F.get("spans", i).alias("s")))
    # each span after what is done already: text up to it as it is, then signs
    step = lambda p: F.concat(
        F.substring(F.col("text"), (p["done"] + 1).cast("int"), F.greatest(F.lit(0), p["s"]["start"] - p["done"]).cast("int")),
        F.repeat(F.lit(sign), F.greatest(F.lit(0), p["s"]["stop"] - F.greatest(p["done"], p["s"]["start"])).cast("int")))
    last = F.array_max(F.transform("spans", lambda s: s["stop"]))
    masked = F.concat(F.array_join(F.transform(pieces, step), ""), F.substring("text", (last + 1).cast("int"), F.char_length("text")))
    return found.select("doc_id", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of find_secrets' rows."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != RANDOM)
    return found.select("doc_id", count(ASSIGN), count(ACCESS), count(HEX), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
