"""License scan: winnowed fingerprints of templates in an inverted index, then banded alignment.

A text and the templates are runs of lower-case words of letters and digits. Of every two
neighbouring word 3-grams the one with the smaller hash is a fingerprint, so any four words that a text shares with a
template in a row share one. Hits near one diagonal are a candidate place; there a local alignment
inside a band around the diagonals of its hits counts the words that match and tells the span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwarden.llm.arrays import NOT_WORD, Words, slices, text_bytes
from clickwarden.llm.license_texts import NOTICES

GRAM = 3
BAND = 8
MATCH, OTHER, GAP = 2, -2, -1
_FOUND = "doc_id long, license_id string, coverage double, matched int, template_words int, span_words int, start long, end long"


def winnow(row: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: of each two neighbouring grams of a row the smaller, a lone gram itself."""
    n = len(gram)
    if not n:
        return np.zeros(0, dtype=np.int64)
    pair = row[1:] == row[:-1]
    smaller = gram[:-1] <= gram[1:]
    chosen = np.zeros(n, dtype=bool)
    chosen[:-1] |= pair & smaller
    chosen[1:] |= pair & ~smaller
    lone = ~np.concatenate([pair, [False]]) & ~np.concatenate([[False], pair])
    return np.flatnonzero(chosen | lone)


def template_index(templates: dict[str, str]) -> dict:
    """Words of each template and (fingerprint, template, position), sorted by fingerprint."""
    names = sorted(templates)
    words, marks, owner, place = [], [], [], []
    for number, name in enumerate(names):
        data = np.frombuffer(templates[name].encode(), np.uint8)
        found = Words(data, np.array([0, len(data)]), NOT_WORD)
        first, gram = found.grams(GRAM)
        at = winnow(np.zeros(len(gram)), gram)
        words.append(found.hash.copy())
        marks.append(gram[at])
        owner.append(np.full(len(at), number))
        place.append(first[at])
    marks, owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (marks, owner, place))
    order = np.argsort(marks, kind="stable")
    return {"names": names, "words": words, "marks": marks[order].astype(np.uint64), "owner": owner[order], "place": place[order]}


def align(template: list[int], text: list[int], low: int, high: int) -> tuple[int, int, int, int]:
    """Best local alignment with text position minus template position between ``low`` and ``high``.

    Returns score, matched words, first word, word after the last. Ties go to more matches, then to the earlier end.
    """
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + low), min(len(text), i + high + 1)):
            score, matched, start = above.get(j - 1, (0, 0, j))
            if word == text[j]:
                cell = (score + MATCH, matched + 1, start)
            else:
                cell = (score + OTHER, matched, start)
            for near in (above.get(j), row.get(j - 1)):
                if near and near[0] + GAP > cell[0]:
                    cell = (near[0] + GAP, near[1], near[2])
            if cell[0] > 0:
                row[j] = cell
                if (cell[0], cell[1]) > best[:2]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best


def _places(hits: list[tuple[int, int]], length: int) -> list[list[tuple[int, int]]]:
    """Hits (text position, template position) grouped into places: near in the text and in diagonal."""
    groups: list[list[tuple[int, int]]] = []
    open_groups: list[list[tuple[int, int]]] = []
    for at, own in sorted(hits):
        open_groups = [g for g in open_groups if at - g[-1][0] <= length + BAND]
        for group in open_groups:
            if abs((at - own) - (group[-1][0] - group[-1][1])) <= BAND and at - group[0][0] <= length + BAND:
                group.append((at, own))
                break
        else:
            open_groups.append([(at, own)])
            groups.append(open_groups[-1])
    return groups


def scan_row(index: dict, words: list[int], hits: dict[int, list[tuple[int, int]]], least: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, word after the last) of the best matches of a text that don't overlap."""
    found = set()
    for number, own in hits.items():
        template = index["words"][number].tolist()
        for group in _places(own, len(template)):
            diagonals = [at - place for at, place in group]
            low, high = min(diagonals) - BAND, max(diagonals) + BAND
            begin = max(0, low)
            score, matched, a, b = align(template, words[begin: max(0, high) + len(template)], low - begin, high - begin)
            if matched and matched >= least * len(template):
                found.add((number, matched, a + begin, b + begin))
    kept: list[tuple[int, int, int, int]] = []
    # the most matching words first, then the template that explains the span best
    for match in sorted(found, key=lambda m: (-m[1], (m[3] - m[2]) + len(index["words"][m[0]]) - 2 * m[1], m[2], m[0])):
        if all(match[3] <= other[2] or match[2] >= other[3] for other in kept):
            kept.append(match)
    return sorted(kept, key=lambda m: m[2])


def _scan(index, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        names = [f.split()[0] for f in _FOUND.split(", ")]
        for batch in batches:
            out = []
            ids = batch.column("doc_id")
            for lo, hi in slices(batch.column("text")):
                data, borders = text_bytes(batch.column("text")[lo:hi])
                words = Words(data, borders, NOT_WORD)
                first, gram = words.grams(GRAM)
                at = winnow(words.row[first], gram)
                left = np.searchsorted(known["marks"], gram[at], side="left")
                right = np.searchsorted(known["marks"], gram[at], side="right")
                rows: dict[int, dict[int, list[tuple[int, int]]]] = {}
                for k in np.flatnonzero(right > left):
                    word = int(first[at[k]])
                    own = rows.setdefault(int(words.row[word]), {})
                    for hit in range(left[k], right[k]):
                        own.setdefault(int(known["owner"][hit]), []).append((word, int(known["place"][hit])))
                for row, hits in rows.items():
                    a, b = np.searchsorted(words.row, [row, row + 1])
                    moved = {t: [(w - a, p) for w, p in h] for t, h in hits.items()}
                    for number, matched, x, y in scan_row(known, words.hash[a:b].tolist(), moved, least):
                        size = len(known["words"][number])
                        out.append((ids[lo + row].as_py(), known["names"][number], matched / size, matched, size, int(y - x),
                                    int(words.start[a + x] - borders[row]), int(words.end[a + y - 1] - borders[row])))
            if out:
                types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """All license notices in all texts: doc_id, license_id, coverage, matched, template_words, span_words, start, end.

    A match has at least ``least`` of the template's words in order; of overlapping ones the best
    stays. ``start`` and ``end`` are UTF-8 byte offsets. Templates of under three words
    are never found. A null or empty text has no match; repeated rows and null ids are scanned like
    others; other columns are ignored. The index grows with the templates only.
    """
    index = docs.sparkSession.sparkContext.broadcast(template_index(NOTICES if templates is None else templates))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(index, least), _FOUND)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_license_scan": op5_license_scan}
SQL: dict[str, str] = {}
