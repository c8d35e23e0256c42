"""What queries read: no nested member beyond those they use."""

import pytest

from regionlab import queries_reference as q
from regionlab.session import narrowed, table

PAGES = (
    "score_report score_per_page region_matches nms_kept page_text_reading_order clean_regions clean_stats char_vocab char_frequency source_profile region_count_stats type_crosstab "
    "fewshot_topk normalize_plain normalize_formulas bbox_scaled crop_boxes chat_transcribe_samples chat_detect_samples"
).split()


@pytest.mark.parametrize("name", PAGES)
def test_lines_are_not_read(spark, tiny, name):
    plan = q.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    reads = [x.split("ReadSchema: ", 1)[1] for x in plan.splitlines() if "ReadSchema: " in x]
    assert reads and not any("lines:" in x or "words:" in x for x in reads)


def test_narrowed(spark, tiny):
    t = table(spark, tiny, "metadata", regions=("text", "bbox"))
    assert [f.name for f in t.schema["regions"].dataType.elementType.fields] == ["bbox", "text"]
    full = table(spark, tiny, "metadata")
    # null elements stay apart from elements whose members are null
    same = lambda df: df.selectExpr("row_id", "transform(regions, r -> r is null) as n", "transform(regions, r -> r.text) as t")
    assert same(t).exceptAll(same(full)).count() == 0 == same(full).exceptAll(same(t)).count()
    with pytest.raises(ValueError):
        narrowed(full.schema["regions"].dataType, ["nothing"])
