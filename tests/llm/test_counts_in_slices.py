import pyarrow as pa

from scholia.llm import quality_rules
from scholia.llm.encoding import slices


def test_counts_are_handed_on_in_slices(spark, monkeypatch):
    """Counts of a batch come in several batches, with every row once and in order."""
    monkeypatch.setattr(quality_rules, "MOST_BYTES", 40)
    rows = spark.createDataFrame([(k, "en", None if k == 3 else f"some words {k} " * (k % 4)) for k in range(20)], "doc_id long, lang string, text string").coalesce(1)
    assert len(list(slices(pa.array(["x" * 30] * 4), 40))) > 1
    got = quality_rules.statistics(rows).collect()
    assert [r.doc_id for r in got] == list(range(20)) and [r.n_words for r in got] == [0 if k == 3 else 3 * (k % 4) for k in range(20)]
