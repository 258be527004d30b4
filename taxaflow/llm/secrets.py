"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Random strings encode badly: a vocabulary made from text gives them few characters per token. Runs of
key-like characters are encoded, or what the patterns leave of them, and those that mix letters and
digits and are under the threshold are spans of kind ``random``, unless they have the form of a known
digest or identifier. In runs with signs the pieces between them are looked at, so that words
glued to a random string do not hide it and signs do not make words look random. Spans are code points,
end exclusive.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import over_slices, small_batches, strings, whole_text
from taxaflow.llm.vocabulary import rank_encoding, tokenizer_path

KINDS = ["assign", "access", "hex", "random"]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more
ASSIGN_VALUE, ACCESS_SPAN = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX_DIGITS = "|".join(f"[0-9a-fA-F]{{{n}}}" for n in (32, 40, 56, 64, 96, 128))
KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}|{HEX_DIGITS})(?![A-Za-z0-9])")  # identifiers and digests
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+=*")  # a run without signs but padding
PIECE = re.compile(r"[A-Za-z0-9]+")
SIGNS = "+/_=-"
LEAST = 20
CHARS_PER_TOKEN = 2.0
BASES = re.compile(r"[ACGTUNacgtun]{12,}")  # nucleotide sequences


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_SPAN]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def lacking(piece: str, encoding, ratio: float) -> float:
    """Characters that a piece lacks at the ratio; numbers and nucleotide sequences only lose.

    A word in capitals counts as what it is in small letters, which the vocabulary knows better.
    """
    if piece.isdigit() or BASES.fullmatch(piece):
        return -len(piece)
    tokens = len(encoding.encode_ordinary(piece))
    if len(piece) > 3 and piece.isalpha() and (piece.isupper() or piece.istitle()):
        tokens = min(tokens, len(encoding.encode_ordinary(piece.lower())))
    return ratio * tokens - len(piece)


def low_stretches(run: str, encoding, ratio: float) -> Iterator[tuple[int, int]]:
    """Stretches of a run's pieces that are long enough and under the ratio.

    A piece scores the characters it lacks at the ratio; signs count nothing. All
    maximal stretches of the scores are found (Ruzzo and Tompa), so a piece under the ratio is always
    in one, whatever stands around it.
    """
    total, kept = 0.0, []  # score before and behind the stretch, its start and end, the last one that began lower
    for m in PIECE.finditer(run):
        before = total
        total += lacking(m[0], encoding, ratio)
        if total <= before:
            continue
        low, start = before, m.start()
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][0] >= low:
                at = kept[at][4]
            if at < 0 or kept[at][1] >= total:
                break
            low, start = kept[at][0], kept[at][2]
            del kept[at:]
        kept.append((low, total, start, m.end(), at))
    return (with_signs(run, start, end) for _, _, start, end, _ in kept if end - start >= LEAST)


def with_signs(run: str, start: int, end: int) -> tuple[int, int]:
    """The stretch with the signs that can only be its own: ``+`` beside it, and any that begin or end the run."""
    while start and run[start - 1] == "+":
        start -= 1
    while end < len(run) and run[end] == "+":
        end += 1
    begins, ends = not run[:start].strip(SIGNS), not run[end:].strip(SIGNS)
    return 0 if begins else start, len(run) if ends else end


def rests(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What spans in order leave of a run, where it is long enough."""
    for s, e in [*taken, (end, end)]:
        if s - start >= LEAST:
            yield start, s
        start = max(start, e)


def random_spans(text: str, found: list[tuple[str, int, int]], encoding, ratio: float) -> Iterator[tuple[str, int, int]]:
    spans, at = sorted((s, e) for _, s, e in found), 0
    reach = list(itertools.accumulate((e for _, e in spans), max))
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and reach[at] <= m.start():
            at += 1
        last = at
        while last < len(spans) and spans[last][0] < m.end():
            last += 1
        for start, end in rests(*m.span(), spans[at:last]):
            run = text[start:end]
            if MIXED.fullmatch(run) and not KNOWN.fullmatch(run) and len(run) < ratio * len(encoding.encode_ordinary(run)):
                yield "random", start, end
                continue
            for s, e in rests(0, len(run), [k.span() for k in KNOWN.finditer(run)]):
                for low, high in low_stretches(run[s:e], encoding, ratio):
                    yield "random", start + s + low, start + s + high


def scan(path: str, ratio: float):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding, rows = rank_encoding(path), []
        for text in strings(batch):
            found = base_spans(text)
            found += random_spans(text, found, encoding, ratio)
            found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
            rows.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "found"])

    return over_slices(find)


def find_secrets(docs: DataFrame, path: str | None = None, ratio: float = CHARS_PER_TOKEN) -> DataFrame:
    """``docs`` with an array ``found`` of (kind, start, end) behind its columns, by start, then kind.

    A null or empty text has no spans. Repeated rows are scanned each. A column named ``found`` must
    be dropped or renamed first.
    """
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    scanned = scan(path or tokenizer_path("byte_bpe_50k.tiktoken"), ratio)
    return small_batches(docs).mapInArrow(scanned, f"{kinds}, found array<struct<kind string, start bigint, end bigint>>")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        kept = F.substr(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        return F.struct(
            F.when(fresh, F.concat(done["out"], kept, F.lit(mark))).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], span["end"]).alias("at"),
        )

    return F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int"))))
