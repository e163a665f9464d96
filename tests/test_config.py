"""Configuration: strict keys, validation, forks, bisection."""

import pytest

from quern.operators import config

STAGE = {"stage": "a", "token_start": 0, "token_end": 100, "sequence_length": 10, "mixture": {"x": 0.6, "y": 0.4}}


def test_valid_and_strict(tmp_path):
    made = config.curriculum({"stages": [STAGE, STAGE | {"stage": "b", "token_start": 100, "token_end": 200}], "seed": "s"})
    assert len(made.stages) == 2 and "x 60.0%" in config.report(made.stages)
    (tmp_path / "c.yaml").write_text("stages:\n- {stage: a, token_start: 0, token_end: 5, sequence_length: 1, mixture: {x: 1.0}}\n")
    assert config.load(str(tmp_path / "c.yaml")).stages[0].mixture == {"x": 1.0}
    with pytest.raises(config.ConfigError, match="no typo"):
        config.curriculum({"stages": [STAGE | {"typo": 1}]})


@pytest.mark.parametrize(
    "change",
    [{"token_end": 0}, {"mixture": {"x": 0.5}}, {"protected_floors": {"x": 0.7}}, {"protected_floors": {"z": 0.1}}, {"scarcity_policy": "none"}],
)
def test_invalid_stages(change):
    with pytest.raises(config.ConfigError):
        config.curriculum({"stages": [STAGE | change]})


def test_gaps_and_no_stages():
    with pytest.raises(config.ConfigError):
        config.curriculum({"stages": [STAGE, STAGE | {"token_start": 101, "token_end": 200}]})
    with pytest.raises(config.ConfigError):
        config.curriculum({"stages": []})


def test_forks():
    main = config.Branch("r", "main")
    assert config.fork([main], "main", "f", 3) == config.Branch("r", "f", "main", 3)
    for parent, new in (("none", "f"), ("main", "main")):
        with pytest.raises(config.ConfigError):
            config.fork([main], parent, new, 3)


def test_bisection_and_steps():
    assert config.bisect(0, 100, lambda x: x >= 37, whole=True) == 37
    assert abs(config.bisect(0.0, 1.0, lambda x: x >= 0.3) - 0.3) < 1e-6
    assert config.one_step([4, 4]) == 4
    with pytest.raises(config.ConfigError):
        config.one_step([1, 2])
