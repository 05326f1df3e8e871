"""Stored results are served only under an equal key and while their rows add up."""

from dataclasses import replace

from pyspark.sql import functions as F

from tallyfold.operators import ledger
from tallyfold.operators import stored as st
from tallyfold.sources.rates import CacheMultipliers
from tests.test_golden import RATES, ROWS, SCHEMA


def test_any_changed_part_misses_and_tampered_rows_are_refused(spark):
    model = ledger.build(spark.createDataFrame(ROWS, SCHEMA), RATES)
    prints = spark.createDataFrame([("s", "8:u8")], "session_id string, print string")
    kept = st.write_results(model, prints, "proportional", RATES)
    keys = st.keyed(prints, "proportional", RATES)
    assert st.served(kept, keys).select("result_id", "total_micros", "attributed_micros", "through_turn").collect() == [("s|proportional|8:u8", 39250, 38250, 5)]
    dearer = replace(RATES, models=(*RATES.models, ("idle", 1, 1, None)))
    slower = replace(RATES, cache=CacheMultipliers(read=200_000))
    for other in (
        st.keyed(prints.withColumn("print", F.lit("9:u9")), "proportional", RATES), st.keyed(prints, "exclusive", RATES),
        st.keyed(prints, "proportional", dearer), st.keyed(prints, "proportional", slower), keys.withColumn("version", F.lit("1")),
        st.keyed(prints.withColumn("session_id", F.lit("t")), "proportional", RATES),
    ):
        assert st.served(kept, other).count() == 0
    more = kept.attribution.withColumn("cost_micros", F.col("cost_micros") + F.when(F.col("component") == "output", 1).otherwise(0))
    assert [r.fault for r in st.restored(st.Results(kept.charge, more, kept.index)).collect()] == ["attributed"]
    total = kept.index.withColumn("total_micros", F.col("total_micros") + 1)
    assert [r.fault for r in st.restored(st.Results(kept.charge, kept.attribution, total)).collect()] == ["total"]
    assert st.served(st.Results(kept.charge, more, kept.index), keys).count() == 0
