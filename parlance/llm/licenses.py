"""Licence scans: sparse TF-IDF cosine to templates, then inheritance.

Every sentence of a file (line ends and ". " separate), every window of
consecutive sentences of at most ``SLACK`` times the words of the longest
template, and every licence file's whole text is compared with the templates,
so notices wrapped over lines are read whole. Full licence texts are known by
their titles and the notices in them. Terms are the templates'
words; idf comes from the files that hold a term, over all files; a word that
no template has counts in the norm with the largest idf. The best cosine at or
above ``threshold`` names the file's own licence. A file without one takes the
licence of the nearest ancestor directory that has a licence file: the
directory's ancestors, the root ('') among them, are exploded and joined on
the path.

Words are the runs of ASCII letters and digits and of all other non-ASCII
characters, lower-cased. Null and empty texts have no licence; a null path
has no directory and inherits nothing. Of licence files in one directory the
best cosine counts, then the smallest path. Equal scores go to the template
that comes first. Repeated rows are scanned each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub

THRESHOLD = 0.75
SLACK = 1.5
CHUNK = 2048  # sentences compared at once
# Usual notice sentences of common licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
]
# Letters lower-cased, ASCII marks blank; line ends stay.
_TABLE = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() or c == 10 else c + 32 if chr(c).isupper() else 32 for c in range(256))


def sentences(text: str) -> list[list[bytes]]:
    parts = text.encode("utf-8", "replace").replace(b". ", b"\n").translate(_TABLE).split(b"\n")
    return [w for w in (p.split() for p in parts) if w]


class Scanner:
    """TF-IDF vectors of the templates over the templates' own terms."""

    def __init__(self, templates, df: dict[bytes, int] | None = None, n: int = 0):
        words = [[w for s in sentences(t) for w in s] for _, t in templates]
        self.names = [x for x, _ in templates]
        self.longest = int(SLACK * max(map(len, words)))
        self.terms = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        idf = [math.log((1 + n) / (1 + (df or {}).get(w, 0))) + 1 for w in self.terms]
        self.idf = np.array(idf + [math.log(1 + n) + 1])  # the last: words of no template
        m = np.stack([np.bincount([self.terms[w] for w in ws], minlength=len(self.terms)) for ws in words]) * self.idf[:-1]
        self.matrix = (m / np.linalg.norm(m, axis=1, keepdims=True)).T

    def _cosines(self, tf: np.ndarray) -> np.ndarray:
        v = tf[:, :-1] * self.idf[:-1]
        return (v @ self.matrix) / np.sqrt((v * v).sum(1) + tf[:, -1] * self.idf[-1] ** 2)[:, None]

    def best(self, parts: list[list[bytes]]) -> tuple[str | None, float, int]:
        """(licence, cosine, index of the first part) of the best matching
        part or window of consecutive parts."""
        found = (None, 0.0, -1)
        get, other = self.terms.get, len(self.terms)
        for start in range(0, len(parts), CHUNK):
            # A part has a word at least, so no window spans more parts.
            some = parts[start:start + CHUNK + self.longest]
            ids = np.array([get(w, other) for p in some for w in p])
            size = np.array([len(p) for p in some])
            of = np.repeat(np.arange(len(some)), size)
            tf = np.bincount(of * (other + 1) + ids, minlength=len(some) * (other + 1)).reshape(len(some), -1)
            upto = np.concatenate((np.zeros((1, other + 1), tf.dtype), np.cumsum(tf, 0)))
            words = np.concatenate(([0], np.cumsum(size)))
            for k in range(1, len(some) + 1):
                at = np.arange(min(CHUNK, len(some) - k + 1))
                if k > 1:
                    at = at[words[at + k] - words[at] <= self.longest]
                    if not len(at):
                        break
                cos = self._cosines(upto[at + k] - upto[at])
                i, name = divmod(int(np.argmax(cos)), cos.shape[1])
                if cos[i, name] > found[1]:
                    found = (self.names[name], float(cos[i, name]), start + int(at[i]))
        return found


def _doc_counts(templates):
    def run(batches):
        terms = Scanner(templates).terms
        df, n = np.zeros(len(terms), np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                seen = terms.keys() & {w for s in sentences(t) for w in s}
                df[[terms[w] for w in seen]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*terms, b""], pa.binary()), pa.array([*df.tolist(), n], pa.int64())], names=["w", "n"])
    return run


def _scan(shared, threshold: float):
    def run(batches):
        s = shared.value
        for b in batches:
            texts, files = b.column(2).to_pylist(), b.column(3).to_pylist()
            out = []
            for t, whole in zip(texts, files):
                parts = sentences(t)
                name, score, _ = s.best(parts)
                if whole and parts:
                    name, score, _ = max((name, score, 0), s.best([[w for p in parts for w in p]]), key=lambda x: x[1])
                out.append((name if score >= threshold else None, score))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["doc_id", "path", "is_file", "own", "score"])
    return run


def scan_licenses(files: DataFrame, path, is_file, threshold: float = THRESHOLD, templates=TEMPLATES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, path, own, score, license, origin): ``path`` and ``is_file``
    (a licence file) are columns of ``files``; ``origin`` is the directory
    that an inherited licence comes from."""
    spark = files.sparkSession
    rows = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.coalesce(is_file, F.lit(False)).alias("is_file"))
    counts = rows.select("t").mapInArrow(_doc_counts(templates), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["w"]): r["n"] for r in counts}  # one row a template term
    shared = spark.sparkContext.broadcast(Scanner(templates, df, df.get(b"", 0)))
    kind = dict(rows.dtypes)["doc_id"]
    own = hub(rows.mapInArrow(_scan(shared, threshold), f"doc_id {kind}, path string, is_file boolean, own string, score double")
              .withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)))
    named = (own.filter("is_file and own is not null and dir is not null").groupBy("dir")
             .agg(F.min_by("own", F.struct(-F.col("score"), "path")).alias("license")))
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = (own.filter("own is null and dir is not null").select("dir").distinct()
             .select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ups))).alias("up")))
    taken = (above.join(named.select(F.col("dir").alias("up"), "license"), "up").groupBy("dir")
             .agg(F.max_by(F.struct("license", "up"), F.length("up")).alias("x")).select("dir", "x.license", F.col("x.up").alias("origin")))
    got = own.join(taken, "dir", "left")
    inherited = F.col("own").isNull()
    return got.select("doc_id", "path", "own", "score", F.coalesce("own", "license").alias("license"), F.when(inherited, F.col("origin")).alias("origin"))
