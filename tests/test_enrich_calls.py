"""The model path: how often the model is called, and for which texts."""

import datetime

from pyspark.sql import functions as F

from conftest import file_rows
from filemason.plans.organize import organize


def test_model_sees_each_file_once_and_whole(spark, tmp_path):
    log = str(tmp_path / "calls")

    def make_model():
        def model(prompts):
            with open(log, "a") as f:
                f.writelines(f"{len(p)}\n" for p in prompts)
            return [('{"summary": "s", "category": "Work", "topics": [], "importance": "low", "suggested_folder": "Work", '
                     '"confidence": 0.9}', 1, 1) for _ in prompts]
        return model

    texts = ["short", "middle " * 100, "long " * 12_000]
    files = file_rows(spark, ["a.txt", "b.txt", "c.txt"], text=texts, size=[len(t) for t in texts],
                      modified_at=[datetime.datetime(2025, 1, 1)] * 3)
    plan = organize(files, "llm", as_of=F.lit("2025-06-01").cast("timestamp"), find_duplicates=False, make_model=make_model)
    assert plan.where("action_type = 'move'").count() == 3
    with open(log) as f:
        sizes = sorted(int(x) for x in f)
    assert len(sizes) == 3 and sizes[-1] > 60_000
