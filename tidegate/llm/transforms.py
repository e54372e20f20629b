"""The operators for training data as transforms of pipeline documents.

Importing this module adds them; an engine does so if its settings name it among the ``plugins``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import languages, leakage, mixture, percentiles
from tidegate.operators.transforms import Inputs, register
from tidegate.sources.base import Config


def _error(config: Config) -> float:
    return float(config.text("error", "0.01"))


def sketch(inputs: Inputs, config: Config) -> DataFrame:
    """``groups``, ``value``, ``error``: counts by bucket, to be merged later."""
    _, df = inputs.one(config)
    return percentiles.sketch(df, config.names("groups"), config.need("value"), _error(config))


def merge_sketches(inputs: Inputs, config: Config) -> DataFrame:
    """``groups`` of one sketch or of several ``inputs`` of the same error."""
    names = config.names("inputs") or inputs.direct
    out = inputs.named(names[0])
    for n in names[1:]:
        out = out.unionByName(inputs.named(n))
    return percentiles.merge(out, config.names("groups"))


def read_percentiles(inputs: Inputs, config: Config) -> DataFrame:
    """``groups``, ``points``, ``error``; from a sketch, or with ``value`` from rows."""
    _, df = inputs.one(config)
    groups = config.names("groups")
    sketched = percentiles.sketch(df, groups, config.need("value"), _error(config)) if config.text("value") else df
    return percentiles.percentiles(sketched, groups, [float(p) for p in config.names("points")], _error(config))


def _texts(inputs: Inputs, config: Config, name: str, key: str) -> DataFrame:
    return inputs.named(config.need(name)).select(F.col(config.text(f"{name}_id", key)).alias(key), F.col(config.text(f"{name}_text", "text")).alias("text"))


def leaks(inputs: Inputs, config: Config) -> DataFrame:
    """``documents``, ``items`` (with ``documents_id``, ``documents_text`` and so on for other names), ``report`` for kinds and shares, ``window``."""
    documents, items = _texts(inputs, config, "documents", "doc_id"), _texts(inputs, config, "items", "item_id")
    find = leakage.leak_report if config.flag("report", False) else leakage.leaks
    return find(documents, items, config.whole("window", leakage.WINDOW))


def mix(inputs: Inputs, config: Config) -> DataFrame:
    """``documents``, ``targets``, ``tokenizer`` (a rank file), ``shards`` or ``shard_tokens``, ``total_tokens``, ``seed``; ``report`` for the shares."""
    whole = lambda key: None if config.get(key) is None else config.whole(key, 0)
    mixture_, report = mixture.mix(
        inputs.named(config.need("documents")), inputs.named(config.need("targets")), config.need("tokenizer"), whole("shards"), whole("total_tokens"),
        config.whole("seed", 1), config.whole("shard_tokens", mixture.SHARD_TOKENS),
    )
    return report if config.flag("report", False) else mixture_


def find_languages(inputs: Inputs, config: Config) -> DataFrame:
    """``documents`` (doc_id, lang, text), ``samples`` (lang, text), one or more: passages with language and confidence; ``cases`` for missing, wrong and mixed ones."""
    documents = inputs.named(config.need("documents"))
    net = languages.trained(*languages.training_pairs(documents, [inputs.named(n) for n in config.names("samples")]))
    found = languages.passages(documents, net)
    return languages.language_cases(found) if config.flag("cases", False) else found


for name, f in {"sketch": sketch, "merge_sketches": merge_sketches, "percentiles": read_percentiles, "leaks": leaks, "mix": mix, "languages": find_languages}.items():
    register(name, f)
