"""What a Python task is given at a time."""

import pyarrow as pa

from tidemark.llm import common


def test_tables_are_made_from_arrow_batches_of_bounded_size(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "rows"])

    docs = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('0123456789', 500) text")
    before = spark.conf.get(common.BATCH_LIMIT, None) if hasattr(common, "BATCH_LIMIT") else None
    met = common.table(docs.mapInArrow(sizes, "size bigint, rows bigint")).collect()
    assert sum(r.rows for r in met) == 4000
    assert max(r.size for r in met) < 5 << 20  # all 4000 rows, 20 MB, came in one batch
    assert spark.conf.get(common.BATCH_LIMIT, None) == before
