"""Property: parse_sequence(linearise(r)) == r for random records of the target schema."""

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions.schema import GT_SCHEMA
from ledgerline.operators import sequence as S

# Values never contain '<' (the tag delimiter), as in the target format.
text = st.text(alphabet=st.characters(blacklist_characters="<", blacklist_categories=("Cs",)), min_size=1, max_size=12)
date = st.one_of(st.none(), st.tuples(st.integers(1, 31), st.integers(1, 12), st.integers(1900, 2100)))


def record():
    fields = {}
    for f in GT_SCHEMA.fields:
        fields[f.name] = date if f.dataType.simpleString().startswith("struct") else st.one_of(st.none(), text)
    return st.fixed_dictionaries(fields)


@settings(max_examples=4, deadline=None, phases=[Phase.explicit, Phase.generate],
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(record(), min_size=1, max_size=40))
def test_round_trip_property(spark, recs):
    rows = [tuple(r[f.name] for f in GT_SCHEMA.fields) for r in recs]
    df = spark.createDataFrame(rows, GT_SCHEMA)
    gt = F.struct(*[F.col(n) for n in GT_SCHEMA.fieldNames()])
    seq = df.select(gt.alias("gt"), S.linearise(gt, GT_SCHEMA).alias("seq"))
    out = seq.select("gt", S.parse_sequence(F.col("seq")).alias("back"))
    assert out.filter(~F.col("gt").eqNullSafe(F.col("back"))).count() == 0
