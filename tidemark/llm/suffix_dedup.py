"""Byte-level dedup in the manner of a bucket-pointer-refined suffix array.

Sampled suffixes start in buckets of their first q bytes; a suffix is a sample if its q-gram is the least
inside some window of the match length. Buckets of one suffix are finished. The others are refined by what
stands at later offsets, first for all windows around a sample at once, and once more per
window where a bucket still holds different texts. Which bucket a suffix is in is a bit that comes back from
the exchange and is used by all later rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm.repeats import Finder, byte_names, byte_packs, find_repeats, spans_of

Q = 24


def dedup_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per document: ``id, n_bytes, spans, kept``.

    ``spans`` are the maximal runs of bytes covered by a ``length``-byte string that also starts in a document
    of a smaller id, judged on the input; ``kept`` holds the other bytes. Matches never cross documents. A null
    text is empty. A null id counts as larger than all others; equal ids are not smaller than each other, so
    repeated rows keep their text unless an earlier document has it. An empty table gives an empty one.
    """

    def result(f: Finder, covered: dict[int, np.ndarray]) -> pd.DataFrame:
        ids, rows = f.table.column("id").to_pylist(), []
        for i, (id_, text) in enumerate(zip(ids, f.table.column("text").to_pylist(), strict=True)):
            raw = (text or "").encode()
            if i not in covered:
                rows.append((id_, len(raw), [], raw))
                continue
            data = np.frombuffer(raw, np.uint8)
            spans = [{"start": int(a), "end": int(b)} for a, b in spans_of(covered[i])]
            rows.append((id_, len(raw), spans, data[~covered[i]].tobytes()))
        out = pd.DataFrame(rows, columns=["id", "n_bytes", "spans", "kept"])
        return out.assign(id=pd.Series(ids, dtype=object))

    kind = docs.schema[id_col].dataType.simpleString()
    return find_repeats(
        docs, id_col=id_col, text_col=text_col, window=length, make_packs=byte_packs, namer=byte_names(min(Q, length)), earlier=True, result=result,
        schema=f"id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary",
    )
