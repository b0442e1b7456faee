"""What grows with the input stays off the driver, also where its compressed files are small enough for Spark to broadcast them."""

from stavelake.llm import common, simhash


def test_links_are_not_broadcast(spark, small, monkeypatch):
    plans, write = [], common._write

    def recorded(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *more)

    monkeypatch.setattr(common, "_write", recorded)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    edited = docs.selectExpr("doc_id + 100000", "concat(text, ' again')")
    assert simhash.near_copies(docs.union(edited), max_bucket=2).count() == 2 * docs.count()
    assert sum("SortMergeJoin" in p for p in plans) > 5
    # The one that stays holds the fingerprints of very many rows, of which there are 65,536 at most.
    assert [p for p in plans if "BroadcastHashJoin" in p] == [p for p in plans if "most" in p and "BroadcastHashJoin" in p] == plans[-1:]
