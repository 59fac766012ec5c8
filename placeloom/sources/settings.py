"""Client settings from YAML: a section llm with `use` (comma list) and, by provider, one mapping or a list of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parsed_settings(text: str) -> list[dict]:
    """One mapping a client, with its provider."""
    import yaml

    llm = (yaml.safe_load(text) or {}).get("llm") or {}
    if not llm:
        raise ValueError("no section llm")
    if not llm.get("use"):
        raise ValueError("no providers in use")
    out = []
    for provider in (p.strip() for p in llm["use"].split(",")):
        own = llm.get(provider)
        if not own:
            raise ValueError(f"no settings for provider {provider}")
        out += [{"provider": provider, **c} for c in ([own] if isinstance(own, dict) else own)]
    return out


def read_settings(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return parsed_settings(f.read())


def settings_table(spark: SparkSession, clients: list[dict]) -> DataFrame:
    """provider, client, model, api_base, rate_limit, quota; keys stay with the driver."""
    rows = [(c["provider"], f"{c['provider']}-{i}", c.get("model"), c.get("api_base"), int(c.get("rate_limit", 5)), c.get("quota")) for i, c in enumerate(clients)]
    return spark.createDataFrame(rows, "provider string, client string, model string, api_base string, rate_limit int, quota long")
