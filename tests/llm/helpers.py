"""Small tables with awkward rows, and brute-force versions of what operators compute."""

from __future__ import annotations

import re
from collections import defaultdict

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use for themselves.
CLASHING = "id string, node string, score string, z string, p string, private string, label string, KEY string, _x0 string"


def documents(spark, rows, clash=False):
    """`rows`: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if clash:
        for part in CLASHING.split(", "):
            name, kind = part.split()
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("own").cast(kind))
    return df


def alnum(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def black(text, lower=True):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, size=3):
    w = black(text)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def least_reachable(ids, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    found = {}
    for start in sorted(ids):
        if start in found:
            continue
        open_, seen = [start], {start}
        while open_:
            for x in near[open_.pop()] - seen:
                seen.add(x)
                open_.append(x)
        found.update(dict.fromkeys(seen, start))
    return found


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
