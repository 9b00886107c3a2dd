"""Chunks of regulation texts: soft wraps undone, then sections cut into an anchor and pieces of bounded size.

Undoing wraps and the filter at the end are native. Cutting one section is a small helper in Python, run by Spark on
Arrow batches of sections; a section is never spread over rows. Sizes are estimated tokens, floor(1.3 * words), or what
a counter given with the limits says, such as a tokenizer's.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.functions import text as T


def size(text: str) -> int:
    return int(1.3 * len(text.split()))


def words_and_marks(text: str) -> int:
    """Runs of letters and digits, and each other character that is no blank."""
    return len(re.findall(r"\w+|[^\w\s]", text))


@dataclass(frozen=True)
class Limits:
    """Sizes in tokens, fixed values by default, and what counts them."""

    least: int = 100
    target: int = 450
    most: int = 900
    overlap: int = 0
    anchor: int = 150
    clause_split: int = 400
    keep: int = 900
    paragraph_split: int = 1200
    count: Callable[[str], int] = size


# Markers that keep their line, and lines that begin a sub-clause or a level of a manual.
MARKER = r"(?:\([a-zA-Z]\)\s|\(\d+\)\s|\([ivxIVX]+\)\s|\d{2,3}\.\d{3}(?:-\d+)?\s|\d+-\d+\.\s|[a-zA-Z]-\d+\s|(?i:Rule)\s+\d+\s)"
SUBCLAUSE = r"\s*\((?:[a-z]|\d+|[ivx]+)\)\s"
MANUAL_SECTION = r"\s*\d+-\d+\.\s"
MANUAL_LEVEL = r"(?i:\s*(?:\d+-\d+\.[a-z]\b|[a-z]\.\s|\(\d+\)\s|\([a-z]\)\s))"
FLAT_MARKER = r"\s(?=\([a-z]|\d+|[ivx]+\)\s)"
_START_ANCHOR = re.compile(T.ANCHOR, re.I)
_START_MANUAL = re.compile(T.MANUAL_ANCHOR)
_KEEP = [re.compile(T.OBLIGATION, re.I), re.compile(T.CROSS_REFERENCE, re.I)]
_CONDITION = re.compile(T.CONDITION_LINE, re.I)


def unwrapped(text: Column, source: Column) -> Column:
    """The text with plain blanks and dashes, words joined over line ends, and wrapped lines joined.

    Blank lines and lines that begin with a marker stay apart. In the manual (EM385) a line is joined only to one that
    doesn't end a sentence, and only if it goes on in lower case, a digit or closing mark.
    """
    t = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\u00a0\u2013\u2014\u2212", " ---"), "\r\n?", "\n")
    t = F.regexp_replace(t, "([A-Za-z])-\n([A-Za-z])", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\f\x0B]+", " "), r"(?m)^ +| +$", "")
    joined = F.regexp_replace(t, rf"(?<=[^\n])\n(?!\n|\z|{MARKER})", " ")
    manual = F.regexp_replace(t, rf"(?<=[^\n.!?:])\n(?=[a-z0-9,;:)\]}}])(?!{MARKER})", " ")
    t = F.when(F.upper(F.coalesce(source, F.lit(""))) == "EM385", manual).otherwise(joined)
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \n"))


def is_anchor(text: str) -> bool:
    line = text.strip().split("\n", 1)[0]
    return bool(_START_ANCHOR.match(line) or _START_MANUAL.match(line))


def _blocks(text: str, start: str) -> list[str]:
    """The text cut before each line that begins as start says."""
    return [b.strip() for b in re.split(rf"(?m)^(?={start})", text) if b.strip()]


class _Packer:
    """Pieces put together while they fit; what a new chunk repeats of the one before is bounded by the overlap."""

    def __init__(self, limits: Limits):
        self.out, self.held, self.n, self.limits = [], [], 0, limits

    def close(self, joint: str) -> None:
        if self.held:
            self.out.append(joint.join(self.held))
        self.held, self.n = [], 0

    def add(self, piece: str, limit: int, joint: str, keep: bool = True) -> None:
        n = self.limits.count(piece)
        if self.held and self.n + n > limit:
            before = self.held
            self.close(joint)
            for x in reversed(before):
                if self.n + self.limits.count(x) > self.limits.overlap:
                    break
                self.held.insert(0, x)
                self.n += self.limits.count(x)
        if keep:
            self.held.append(piece)
            self.n += n


def _forced(sentence: str, limits: Limits) -> list[str]:
    """A sentence beyond the limit: at markers, else at semicolons, if that is enough; else by words."""
    for cut in (FLAT_MARKER, r";\s+"):
        parts = [p.strip() for p in re.split(cut, sentence) if p.strip()]
        if len(parts) > 1 and all(limits.count(p) <= limits.most for p in parts):
            return parts
    words, step = sentence.split(), max(1, int(limits.target / 1.3))
    return [" ".join(words[a : a + step]) for a in range(0, len(words), step)]


def paragraph_chunks(text: str, limits: Limits = Limits()) -> list[str]:
    """Paragraphs put together up to the target; longer ones by sentence; small chunks merged."""
    pack = _Packer(limits)
    for paragraph in filter(None, map(str.strip, re.split(r"\n\n+", text))):
        if limits.count(paragraph) <= limits.most:
            pack.add(paragraph, min(limits.most, limits.target), "\n\n")
            continue
        pack.close("\n\n")
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            fits = limits.count(sentence) <= limits.most
            pack.add(sentence, limits.target, " ", keep=fits)
            if not fits:
                pack.out += _forced(sentence, limits)
    pack.close("\n\n")
    return merged(pack.out, limits)


def merged(chunks: list[str], limits: Limits) -> list[str]:
    """Chunks below the least size, but for anchors, joined to the one before, else to the one after, where that fits."""
    out, rest = [], list(reversed(chunks))
    while rest:
        now = rest.pop()
        n = limits.count(now)
        if n < limits.least and not is_anchor(now):
            if out and limits.count(out[-1]) + n <= limits.most:
                out[-1] += "\n\n" + now
                continue
            if rest and n + limits.count(rest[-1]) <= limits.most:
                now += "\n\n" + rest.pop()
        out.append(now)
    return out


def bounded(text: str, limits: Limits) -> list[str]:
    return ([text] if limits.count(text) <= limits.most else paragraph_chunks(text, limits)) if text else []


def section_chunks(text: str, source: str, limits: Limits = Limits()) -> list[tuple[str, bool]]:
    """(text, is_anchor) of one section's chunks: the anchor (its first paragraph, and two more within the anchor's
    size), then the rest: whole if it must stay so or is short, else by clause, sub-clause and paragraph."""
    text, source = (text or "").strip(), (source or "").upper()
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n+", text) if p.strip()]
    if not paragraphs:
        return []
    head = 1
    while head < min(3, len(paragraphs)) and limits.count("\n\n".join(paragraphs[: head + 1])) <= limits.anchor:
        head += 1
    out = [(part, True) for part in bounded("\n\n".join(paragraphs[:head]), limits)]
    rest = "\n\n".join(paragraphs[head:])
    must_stay = any(k.search(text) for k in _KEEP) or len(_CONDITION.findall(text)) >= 2
    body: list[str] = []
    if must_stay or limits.count(text) <= limits.keep:
        body = bounded(rest, limits)
    else:
        clause = {"EM385": MANUAL_SECTION, "FAR": "(?i:" + T.ANCHOR[1:] + ")", "DFARS": "(?i:" + T.ANCHOR[1:] + ")"}.get(source)
        level = {"EM385": MANUAL_LEVEL, "FAR": SUBCLAUSE, "DFARS": SUBCLAUSE}.get(source)
        for block in _blocks(rest, clause) if clause and limits.count(rest) >= limits.clause_split else filter(None, [rest]):
            if limits.count(block) <= limits.keep:
                body += bounded(block, limits)
                continue
            for part in _blocks(block, level) if level else [block]:
                body += merged(paragraph_chunks(part, limits) if limits.count(part) > limits.paragraph_split else bounded(part, limits), limits)
    return out + [(x, False) for x in _joined_small(body, limits)]


def _joined_small(chunks: list[str], limits: Limits) -> list[str]:
    """As merged, but a small chunk that goes to the next may, with it, go on to the one after."""
    out, carried = [], ""
    for k, chunk in enumerate(chunks):
        now = f"{carried}\n\n{chunk}" if carried else chunk
        carried = ""
        if limits.count(now) < limits.least and not is_anchor(now):
            if out and limits.count(out[-1]) + limits.count(now) <= limits.most:
                out[-1] += "\n\n" + now
                continue
            if k + 1 < len(chunks) and limits.count(now) + limits.count(chunks[k + 1]) <= limits.most:
                carried = now
                continue
        out.append(now)
    return out


def chunk_sections(sections: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, section, chunk (from 0), text, is_anchor, n_tokens of sections(doc_id, section, source, text).

    Null and blank texts have no chunk. A document without sections is given as one row whose section is null; it is
    cut by paragraphs, without an anchor.
    """

    def cut(batches):
        for b in batches:
            rows = []
            for doc, section, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = section_chunks(text, source, limits) if section is not None else [(x, False) for x in paragraph_chunks(text or "", limits)]
                rows += [(doc, section, k, x, anchor, limits.count(x)) for k, (x, anchor) in enumerate(found)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["doc_id", "section", "chunk", "text", "is_anchor", "n_tokens"])

    read = sections.select(F.col("doc_id").cast("long"), F.col("section").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return read.mapInArrow(cut, "doc_id long, section long, chunk int, text string, is_anchor boolean, n_tokens long")


def halved(text: str, limits: Limits) -> list[str]:
    """The text in halves of words, a word in halves of characters, until each is within the limit."""
    if limits.count(text) <= limits.most or len(text) < 2:
        return [text]
    words, joint = (text.split(), " ") if len(text.split()) > 1 else (text.strip(), "")
    at = len(words) // 2
    return [x for part in (words[:at], words[at:]) for x in halved(joint.join(part), limits)]


def recut(chunks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """chunks(doc_id, section, chunk, text, is_anchor) with piece (from 0) and n_tokens by the limits' counter: those above
    the limit, as merging or another counter may leave them, cut again by paragraphs, and by halves where that isn't enough.

    No piece is above the limit, but for one character that is by itself. Null texts are empty and stay.
    """

    def cut(batches):
        for b in batches:
            rows = []
            for doc, section, chunk, text, anchor in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                parts = [text] if limits.count(text) <= limits.most else [x for p in paragraph_chunks(text, limits) for x in halved(p, limits)]
                rows += [(doc, section, chunk, k, x, anchor, limits.count(x)) for k, x in enumerate(parts)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["doc_id", "section", "chunk", "piece", "text", "is_anchor", "n_tokens"])

    read = chunks.select(F.col("doc_id").cast("long"), F.col("section").cast("long"), F.col("chunk").cast("int"), F.col("text").cast("string"), F.col("is_anchor").cast("boolean"))
    return read.mapInArrow(cut, "doc_id long, section long, chunk int, piece int, text string, is_anchor boolean, n_tokens long")


def stored(chunks: DataFrame, least: int = 100) -> DataFrame:
    """The chunks that are worth keeping: those that pass the quality gate and are large enough, or begin as anchors."""
    return chunks.where(T.passes_quality_gate(F.col("text")) & ((F.col("n_tokens") >= least) | T.is_anchor(F.col("text"))))
