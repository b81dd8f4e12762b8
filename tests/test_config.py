import json

import pytest

from treeledger.sources import config


@pytest.mark.parametrize(
    "found,said",
    [([], "must be an object"), ({"x": 1}, "unknown key x"), ({"rank": {"top": 0}}, "rank.top"), ({"rank": {"top": True}}, "rank.top"), ({"gate": {"tolerance": {"y": 1}}}, "unknown key gate.tolerance.y"), ({"includeTests": 1}, "true or false"), ({"gate": {"matchSimilarityPercent": 101}}, "at most 100"), ({"duplication": 3}, "must be an object")],
)
def test_what_is_refused(found, said):
    with pytest.raises(config.ConfigError, match=said):
        config.validate(found, "f.json")


def test_nearest_file_and_precedence(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / config.NAME).write_text(json.dumps({"rank": {"top": 3}, "failOnError": True, "gate": {"tolerance": {"ncss": 9}, "newFunction": {"maxNcss": 7}}}))
    found = config.load(None, str(tmp_path / "a/b"))
    assert config.resolve({"top": None, "minTokens": 5}, found) == {"top": 3, "includeTests": False, "failOnError": True, "minTokens": 5, "maxGapTokens": 30, "minSimilarityPercent": 70}
    options = config.gate_options(found)
    assert (options.tolerance.ncss, options.limits.ncss, options.limits.cognitive, options.similarity_percent) == (9, 7, 15, 70)
    (tmp_path / "a" / config.NAME).write_text("{")
    with pytest.raises(config.ConfigError, match="not JSON"):
        config.load(None, str(tmp_path / "a/b"))
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "none.json"), ".")
