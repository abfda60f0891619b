"""Settings, prompts and local discovery."""

import pytest

from grainmill import config
from grainmill.operators import prompts
from grainmill.sources import files


def test_parsers():
    assert config.split_list(" a, ,b ") == ["a", "b"] and config.positive_int("3") == 3 and config.non_negative("0") == 0.0
    assert config.seed_of("None") is None and config.seed_of("7") == 7 and config.cell_flag(" a = b=c ") == ("a", "b=c")
    for f, bad in ((config.positive_int, "0"), (config.non_negative, "-1"), (config.non_negative, "nan"), (config.cell_flag, "a"), (config.cell_flag, "=b")):
        with pytest.raises(ValueError):
            f(bad)
    assert config.Settings().near_threshold == 0.7


def test_local_files_stay_inside(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "out.py").write_text("")
    (tmp_path / "in/b.py").write_text("")
    (tmp_path / "in/sub/a.py").write_text("")
    (tmp_path / "in/link.py").symlink_to(tmp_path / "out.py")
    assert [p.split("/in/")[1] for p in files.local_files(str(tmp_path / "in"))] == ["b.py", "sub/a.py"]


def test_prompts(spark):
    rows = spark.createDataFrame([(1, "A cat.", None)], "i int, premise string, hypothesis string")
    got = {(r.template, r.instr): r.prompt for r in prompts.prompts(spark, rows, "inference").collect()}
    assert len(got) == 8 and got["2", "en"].startswith("Premise: A cat.\nHypothesis: \n") and got["1", "es"].endswith("\nAnswer:")
    assert len(prompts.templates()) == 32
    nested = spark.createDataFrame([(("Where?", (["here", "there"],)), " b ")], "question struct<stem:string, choices:struct<text:array<string>>>, answerKey string")
    r = prompts.flat_choices(nested).first()
    assert (r.stem, r.options, r.gold) == ("Where?", "A) here B) there", "B")
