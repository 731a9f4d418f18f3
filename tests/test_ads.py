from quorix.plans.models import QUERIES
from quorix.session import table


def test_all_tables_of_the_ads_pipeline_are_registered(spark, data_dir):
    rows = [(r.row_id, r.split) for r in QUERIES["ads_tables"](spark, data_dir).select("row_id", "split").collect()]
    ids = [r.doc_id for r in table(spark, data_dir, "documents").where("text IS NOT NULL").select("doc_id").collect()]
    assert sorted(rows) == sorted((i, "test" if i % 10 == 0 else "train") for i in ids)
    assert {"ads_counts", "ads_histogram", "ads_dictionary"} <= set(QUERIES)
