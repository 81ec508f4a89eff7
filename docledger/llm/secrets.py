"""Secret scan: patterns find candidates, a random forest takes out the false ones.

Candidates are values assigned to a key that sounds secret, tokens of known issuers, key
blocks, and long runs of key characters. Issuers' tokens and key blocks leave no doubt, so they
are secrets whatever the forest says. Of the others, the forest sees how long a candidate is, how its
characters change class, how much of it dictionary syllables cover, its document's path
(the source), and the words beside it, but not which pattern found it. It is trained by
Spark ML on labelled findings; the trees, a few thousand nodes, are then applied to each
document in the scan that redacts it, so texts are never shuffled.

``labelled_findings`` labels findings where their form leaves no doubt. Any table of
``candidate, before, after, path, label`` may be used instead. Training takes a sample of at
most ``SAMPLE`` findings of either label; scanning covers all texts whole.

Defined results: null text stays null and has no findings, empty text stays empty. A null
path is an empty one. Findings that overlap are one finding. Repeated rows get the same answer. With findings of one label only,
no forest can be trained and every candidate of a known form counts as secret. An empty
table gives no rows. Other columns are kept as they are by ``redacted``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import scratch_folder
from .tables import frugal, save

SAMPLE = 5_000
TREES = 24
DEPTH = 7
SEED = 17
REDACTED = "[SECRET]"

# Key words, issuers' forms, placeholders.
KEY_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "auth", "credential")
ISSUED = re.compile(r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[baprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}"
                    r"|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})", re.ASCII)
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.ASCII | re.DOTALL)
ASSIGNED = re.compile(r"(?:" + "|".join(KEY_WORDS) + r")[\"']?[ \t]{0,4}[:=]>?[ \t]{0,4}[\"']?([^\s\"',;]{6,})", re.ASCII | re.IGNORECASE)
LONG_WORD = re.compile(r"[0-9A-Za-z+/_-]{16,}", re.ASCII)
PLACEHOLDER = re.compile(r"example|change_?me|your|placeholder|dummy|test|xxxx|\*{3}|<[^>]*>", re.IGNORECASE)
SYLLABLES = ("the and ing tion ent ion her ver ter con pro com est ate men tra ene ous ble ide que des les una por "
             "ado cio ich sch ein und ung gen den ver aux ment oir eau").split()

FEATURES = ["length", "digits", "upper", "other", "changes", "entropy", "vowels", "covered", "hexadecimal",
            "path_length", "path_depth", "path_test", "key_word", "assigns", "quoted", "before_length", "after_length"]
FINDING = "candidate STRING, before STRING, after STRING, path STRING"


#: Rules whose findings are secrets by their form, and all rules, the surest first.
CERTAIN = ("block", "issued")
RULES = (*CERTAIN, "assigned", "run")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, rule)`` of all candidates in order, each span once by its surest rule.

    Candidates may overlap: which of them stand is known only once they are scored.
    """
    found = []
    if any(c in text for c in "=:"):
        low = text.lower()
        if any(k in low for k in KEY_WORDS):
            found += [(m.start(1), m.end(1), "assigned") for m in ASSIGNED.finditer(text)]
    if "-----BEGIN" in text:
        found += [(m.start(), m.end(), "block") for m in BLOCK.finditer(text)]
    found += [(*m.span(), "issued") for m in ISSUED.finditer(text)]
    found += [(*m.span(), "run") for m in LONG_WORD.finditer(text) if not m[0].isalpha() and not m[0].isdigit()]
    spans: dict[tuple[int, int], str] = {}
    for a, b, rule in sorted(found, key=lambda f: RULES.index(f[2])):
        spans.setdefault((a, b), rule)
    return [(a, b, rule) for (a, b), rule in sorted(spans.items())]


def merged(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Findings ``(start, end, rule, score)`` in order, overlapping ones as one by the surest rule."""
    out: list[tuple[int, int, str, float]] = []
    for a, b, rule, score in sorted(found):
        if out and a < out[-1][1]:
            first, last, other, best = out[-1]
            out[-1] = (first, max(b, last), min(rule, other, key=RULES.index), max(score, best))
        else:
            out.append((a, b, rule, score))
    return out


def around(text: str, start: int, end: int, width: int = 32) -> tuple[str, str]:
    return text[max(0, start - width) : start], text[end : end + width]


def features(candidate: str, before: str, after: str, path: str) -> list[float]:
    """The numbers in the order of ``FEATURES``."""
    n = max(len(candidate), 1)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in candidate]
    low = candidate.lower()
    shares = [low.count(c) / n for c in set(low)]
    covered = np.zeros(len(low), bool)
    for s in SYLLABLES:
        at = low.find(s)
        while at >= 0:
            covered[at : at + len(s)] = True
            at = low.find(s, at + 1)
    words = before.split()
    near = before.lower()
    return [
        float(min(len(candidate), 400)), kinds.count("d") / n, kinds.count("u") / n, kinds.count("o") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, -sum(p * math.log2(p) for p in shares),
        sum(c in "aeiou" for c in low) / n, float(covered.mean()) if len(low) else 0.0,
        sum(c in "0123456789abcdef" for c in low) / n, float(len(path)), float(path.count("/") + path.count(".")),
        float(bool(re.search("test|example|sample|doc", path.lower()))), float(any(k in near for k in KEY_WORDS)),
        float(bool(re.search(r"[:=][\s\"']*$", before))), float(before[-1:] in "\"'" and before != ""),
        float(len(words[-1]) if words else 0), float(len(after.split()[0]) if after.split() else 0),
    ]


def label(candidate: str, rule: str) -> int | None:
    """1 or 0 where the form leaves no doubt, else None."""
    if PLACEHOLDER.search(candidate) and not ISSUED.match(candidate):
        return 0
    if rule in ("issued", "block"):
        return 1
    digits, letters = any(c.isdigit() for c in candidate), any(c.isalpha() for c in candidate)
    if rule == "assigned":
        return 1 if digits and letters and len(candidate) >= 8 else 0 if not digits else None
    parts = re.split("[-_/+]", candidate)
    if all(p.isalpha() or p.isdigit() or not p for p in parts):  # words, numbers, dates, phones
        return 0
    return None


def labelled_findings(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """``candidate, before, after, path, label`` of the findings whose form tells their label."""

    def run(batches):
        for batch in batches:
            out = []
            for t, where in zip(batch.column("_text").to_pylist(), batch.column("_path").to_pylist()):
                for a, b, rule in candidates(t or ""):
                    known = label(t[a:b], rule)
                    if known is not None:
                        out.append((t[a:b], *around(t, a, b), where or "", known))
                for m in LONG_WORD.finditer(t or ""):  # words and numbers that only look like keys
                    if m[0].isalpha() or m[0].isdigit():
                        out.append((m[0], *around(t, *m.span()), where or "", 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], pa.string()) for k in range(4)] + [pa.array([o[4] for o in out], pa.int32())],
                names=["candidate", "before", "after", "path", "label"])

    return docs.select(F.col(text).alias("_text"), F.col(path).cast("string").alias("_path")).mapInArrow(frugal(run), FINDING + ", label INT")


class Forest:
    """Trees as arrays; the answer is the mean share of secrets over the leaves reached."""

    def __init__(self, rows):
        self.trees = []
        for tree in sorted({r["treeID"] for r in rows}):
            nodes = {n["id"]: n for n in (r["nodeData"] for r in rows if r["treeID"] == tree)}
            size = max(nodes) + 1
            feature, cut = np.full(size, -1), np.zeros(size)
            left, right, share = np.zeros(size, int), np.zeros(size, int), np.zeros(size)
            for k, n in nodes.items():
                total = sum(n["impurityStats"])
                share[k] = n["impurityStats"][1] / total if total and len(n["impurityStats"]) > 1 else 0
                if n["leftChild"] >= 0:
                    feature[k], cut[k] = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
                    left[k], right[k] = n["leftChild"], n["rightChild"]
            self.trees.append((feature, cut, left, right, share))

    def shares(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += share[at]
        return total / max(len(self.trees), 1)


def train(findings: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> Forest | None:
    """A forest from ``candidate, before, after, path, label``; at most ``sample`` of either label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    spark = findings.sparkSession
    findings = findings.dropna(subset=["candidate", "label"]).fillna("", ["before", "after", "path"])
    order = F.xxhash64("candidate", "before", "path")
    picked = [findings.where(F.col("label") == k).distinct().orderBy(order, "candidate", "after").limit(sample) for k in (0, 1)]

    def measure(batches):
        for batch in batches:
            parts = (batch.column(k).to_pylist() for k in ("candidate", "before", "after", "path"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([features(*r) for r in zip(*parts)], pa.list_(pa.float64()))], names=["label", "x"])

    both = picked[0].unionByName(picked[1]).withColumn("label", F.col("label").cast("int"))
    data = save(both.mapInArrow(frugal(measure), "label INT, x ARRAY<DOUBLE>"), "features")
    if data.select("label").distinct().count() < 2:
        return None
    data = data.coalesce(1).sortWithinPartitions("label", "x").withColumn("features", array_to_vector("x"))  # always the same trees
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(data.select("label", "features"))
    path = scratch_folder(spark, "forest")
    model.write().save(path)
    return Forest(spark.read.parquet(f"{path}/data").collect())


def scan(docs: DataFrame, forest: Forest | None, keep: list[str], text: str = "text", path: str = "source", threshold: float = 0.5) -> DataFrame:
    """The columns ``keep`` with ``llm_candidates`` (their number), ``llm_findings`` (the secrets)
    and ``llm_redacted`` (the text without them)."""
    model = docs.sparkSession.sparkContext.broadcast(forest)
    struct = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("rule", pa.string()), ("score", pa.float64())])
    names = [*keep, "llm_candidates", "llm_findings", "llm_redacted"]

    def run(batches):
        for batch in batches:
            texts, paths = (batch.column(k).to_pylist() for k in (len(keep), len(keep) + 1))
            spans, rows = [], []
            for k, (t, where) in enumerate(zip(texts, paths)):
                for a, b, rule in candidates(t or ""):
                    spans.append((k, a, b, rule))
                    rows.append(features(t[a:b], *around(t, a, b), where or ""))
            if model.value is None:
                scores = [float(label(texts[k][a:b], rule) == 1) for k, a, b, rule in spans]
            else:
                scores = model.value.shares(np.array(rows).reshape(len(rows), len(FEATURES))).tolist()
            count, found = [0] * len(texts), [[] for _ in texts]
            for (k, a, b, rule), score in zip(spans, scores):
                count[k] += 1
                score = 1.0 if rule in CERTAIN else score
                if score >= threshold:
                    found[k].append((a, b, rule, score))
            found = [merged(fs) for fs in found]
            for k, fs in enumerate(found):
                if fs:
                    edges = [0, *(e for a, b, _, _ in fs for e in (a, b)), len(texts[k])]
                    texts[k] = REDACTED.join(texts[k][a:b] for a, b in zip(edges[::2], edges[1::2]))
            found = [[{"start": a, "length": b - a, "rule": rule, "score": score} for a, b, rule, score in fs] for fs in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(count, pa.int64()), pa.array(found, pa.list_(struct)), pa.array(texts, pa.string())],
                names=names)

    rows = docs.select(*(docs[c] for c in keep), docs[text].alias("llm_text"), docs[path].cast("string").alias("llm_path"))
    found = "ARRAY<STRUCT<start: INT, length: INT, rule: STRING, score: DOUBLE>>"
    extra = T._parse_datatype_string(f"llm_candidates LONG, llm_findings {found}, llm_redacted STRING")
    return rows.mapInArrow(frugal(run), T.StructType([*(docs.schema[c] for c in keep), *extra.fields]))


def redacted(docs: DataFrame, forest: Forest | None, text: str = "text", path: str = "source") -> DataFrame:
    """All columns, with the secrets taken out of the text."""
    rows = scan(docs, forest, docs.columns, text, path)
    return rows.select(*(F.col("llm_redacted").alias(c) if c == text else F.col(c) for c in docs.columns))


def train_on(docs: DataFrame, text: str = "text", path: str = "source") -> Forest | None:
    """A forest from the findings in ``docs`` whose form tells their label."""
    return train(save(labelled_findings(docs, text, path), "findings"))
