from __future__ import annotations

import pytest

from contextloom import config


def test_inheritance_and_layers(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "context.toml").write_text('[profile.default]\nmax_tokens = 10\n[profile.a]\nextends = "b"\nformat = "xml"\nnonsense = 1\n[profile.b]\nignore = ["x"]\n[profile.b.relevance]\ntier_0 = ["*.md"]\n[profile.c]\nextends = "d"\n[profile.d]\nextends = "c"\n')
    deep = tmp_path / "p" / "q"
    deep.mkdir(parents=True)
    profiles = config.load_profiles(config.find_upward("context.toml", deep))
    profile, chain = config.resolved("a", profiles)
    assert chain == ("a", "b", "default") and (profile.max_tokens, profile.format, profile.ignore, profile.tiers) == (10, "xml", ("x",), {0: ("*.md",)})
    with pytest.raises(ValueError, match="circular"):
        config.resolved("c", profiles)
    with pytest.raises(KeyError):
        config.resolved("missing", profiles)
    over = config.layered(profile, env={"CONTEXT_MAX_TOKENS": "77", "CONTEXT_COMPRESSION": "yes"}, target="claude", flags={"tokenizer": "none"})
    assert (over.max_tokens, over.format, over.compression) == (200_000, "xml", True)
    assert config.layered(profile, env={"CONTEXT_MAX_TOKENS": "many"}).max_tokens == 10
    with pytest.raises(ValueError, match="unknown target"):
        config.layered(profile, env={}, target="nobody")


def test_problems():
    bad = config.Profile(format="pdf", max_tokens=-1, tiers={0: ("*.md",), 3: ("*.md", "{a")})
    kinds = [p[0] for p in config.problems("x", bad)]
    assert kinds.count("error") == 3 and kinds.count("warning") == 1
    assert config.problems("x", config.Profile()) == []
