"""Columns that name and rank evaluation runs from their keys and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Display orders; what is missing from one ranks 99.
FAMILY_RANK = {"llama": 0, "gemma": 1}
GROUP_RANK = {"Prompting": 0, "Post-Training": 1, "CAI": 2, "Probe": 3, "Unknown": 99}
VARIANT_RANK = {"Zero-shot": 0, "4-shot": 1, "SFT": 2, "DPO": 3, "DPO (Base)": 4, "DPO (From SFT)": 5, "Middle layer": 6, "75% depth layer": 7, "Last layer": 8}
GROUP_VARIANT_RANK = {
    "Prompting": {"Zero-shot": 0, "4-shot": 1},
    "Post-Training": {"SFT": 0, "DPO": 1},
    "CAI": {"SFT": 0, "DPO (Base)": 1, "DPO (From SFT)": 2, "DPO": 3},
}
SOURCE_RANK = {"Prompting Zero-shot": 0, "Prompting 4-shot": 1, "Post-Training SFT": 2, "Post-Training DPO": 3, "Unknown source": 99}
SETTING_RANK = {"n/a": -1, "Zero-shot": 0, "4-shot": 1, "Unknown": 2}
LAYER_NAME = {"middle": "Middle layer", "layer_75pct": "75% depth layer", "75pct": "75% depth layer", "last": "Last layer"}
FAMILY_NAME = {"llama": ("Llama 3.2 3B", "Llama"), "gemma": ("Gemma 3 4B", "Gemma")}
SHORT_VARIANT = {
    ("Prompting", "Zero-shot"): "0-SHOT",
    ("Prompting", "4-shot"): "4-SHOT",
    ("Post-Training", "SFT"): "SFT",
    ("Post-Training", "DPO"): "DPO",
    ("CAI", "SFT"): "CAI-SFT",
    ("CAI", "DPO (Base)"): "CAI DPO BASE",
    ("CAI", "DPO (From SFT)"): "CAI DPO SFT",
    ("CAI", "DPO"): "CAI DPO",
}
MISSING_RANK = 99


def looked_up(c: Column, table: dict, default) -> Column:
    """A literal table's value for `c`, or the default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def _holds(c: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def haystack(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def model_family(key: Column, family: Column, model: Column) -> Column:
    family = F.trim(F.lower(F.coalesce(family, F.lit(""))))
    hay = haystack(key, family, model)
    return F.when(hay.contains("llama"), "llama").when(hay.contains("gemma"), "gemma").when(family != "", family).otherwise("unknown")


#: Words in a run's names, and what they tell, the first that holds.
GROUP_WORDS = {"CAI": ("self_full", "_model_eval"), "Post-Training": ("sft_zeroshot_eval", "dpo_zeroshot_eval"), "Probe": ("probe",), "Prompting": ("4shot", "4-shot", "zeroshot", "zero-shot")}
CAI_WORDS = {"DPO (From SFT)": ("dpo_from_sft",), "DPO (Base)": ("dpo_base",), "DPO": ("dpo",), "SFT": ("sft",)}
POST_WORDS = {"DPO": ("dpo",), "SFT": ("sft",)}
SHOT_WORDS = {"4-shot": ("4shot", "4-shot"), "Zero-shot": ("zeroshot", "zero-shot")}
PROBE_WORDS = {"4-shot": ("4shot", "4-shot"), "Zero-shot": ("zeroshot", "zero-shot", "probe_base")}
SOURCE_WORDS = {
    "Post-Training SFT": ("_sft_probe", "sft_zeroshot_eval"),
    "Post-Training DPO": ("_dpo_probe", "dpo_zeroshot_eval"),
    "Prompting 4-shot": ("probe_4shot", "4shot", "4-shot"),
    "Prompting Zero-shot": ("probe_base", "zeroshot", "zero-shot"),
}
#: What a number of shots tells where words don't.
SHOTS = {4: ("4-shot", "Prompting 4-shot"), 0: ("Zero-shot", "Prompting Zero-shot")}


def told(hay: Column, words: dict[str, tuple[str, ...]], otherwise, shots: Column | None = None) -> Column:
    """The first name of `words` any of whose words is in `hay`, or that the number of shots stands for; else `otherwise`."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for name, any_of in reversed(words.items()):
        holds = _holds(hay, *any_of)
        for n, names in SHOTS.items():
            holds = holds | (shots == n) if shots is not None and name in names else holds
        out = F.when(holds, name).otherwise(out)
    return out


def run_group(key: Column, output_dir: Column, model: Column, source: Column) -> Column:
    return F.when(source.isin(*GROUP_WORDS), source).otherwise(told(haystack(key, output_dir, model), GROUP_WORDS, "Unknown"))


def eval_variant(key: Column, output_dir: Column, model: Column, shots: Column, group: Column) -> Column:
    hay, shots = haystack(key, output_dir, model), F.coalesce(shots, F.lit(0)).cast("int")
    named = F.concat(shots.cast("string"), F.lit("-shot"))
    in_prompting = told(hay, SHOT_WORDS, named, shots)
    # Elsewhere, words for zero shots alone don't tell.
    elsewhere = told(hay, POST_WORDS, told(hay, {"4-shot": SHOT_WORDS["4-shot"], "Zero-shot": ()}, named, shots))
    return F.when(group == "CAI", told(hay, CAI_WORDS, "Unknown")).when(group == "Post-Training", told(hay, POST_WORDS, "Unknown")).when(group == "Prompting", in_prompting).otherwise(elsewhere)


def layer_name(tag: Column) -> Column:
    key = F.lower(F.trim(tag))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in LAYER_NAME.items() for x in kv]), key)
    return F.coalesce(known, F.when(key.contains("75"), "75% depth layer").when(key.contains("mid"), "Middle layer").when(key.contains("last"), "Last layer").otherwise(tag))


def probe_setting(key: Column, samples: Column, output_dir: Column) -> Column:
    return told(haystack(key, samples, output_dir), PROBE_WORDS, "Unknown")


def probe_source(key: Column, samples: Column, output_dir: Column, model: Column, shots: Column) -> Column:
    return told(haystack(key, samples, output_dir, model), SOURCE_WORDS, "Unknown source", F.coalesce(shots, F.lit(0)).cast("int"))


def family_name(family: Column, short: bool = False) -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for k, v in FAMILY_NAME.items() for x in (k, v[short])]), family)
    return F.coalesce(known, family)


def run_display(family: Column, group: Column, variant: Column) -> Column:
    middle = F.when(group.isin("Prompting", "Post-Training", "CAI"), F.concat(F.lit(" "), group)).otherwise("")
    return F.concat(family_name(family, short=True), middle, F.lit(" "), variant)


def short_display(family: Column, group: Column, variant: Column) -> Column:
    table = {f"{g}|{v}": s for (g, v), s in SHORT_VARIANT.items()}
    short = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.concat(group, F.lit("|"), variant)), variant)
    name = F.when(family.isin(*FAMILY_NAME), family_name(family, short=True)).otherwise(F.coalesce(F.nullif(F.initcap(F.trim(family)), F.lit("")), F.lit("Model")))
    return F.concat(name, F.lit(" "), short)


def probe_display(family: Column, setting: Column, source: Column, layer: Column | None = None) -> Column:
    """A probe's name; with `layer`, that of one of its layers."""
    middle = F.when(F.coalesce(source, F.lit("Unknown source")).isin("", "Unknown source"), F.when(F.coalesce(setting, F.lit("Unknown")).isin("", "Unknown"), "").otherwise(F.concat(F.lit(" Prompting "), setting))).otherwise(F.concat(F.lit(" "), source))
    tail = F.concat(F.lit(" ("), layer, F.lit(")")) if layer is not None else F.lit("")
    return F.concat(family_name(family, short=True), F.lit(" Probe"), middle, tail)


def variant_rank(group: Column, variant: Column) -> Column:
    out = looked_up(variant, VARIANT_RANK, MISSING_RANK)
    for g, table in GROUP_VARIANT_RANK.items():
        out = F.when(group == g, looked_up(variant, table, MISSING_RANK)).otherwise(out)
    return out


def model_slug(name: Column) -> Column:
    """A model's name as a file name part."""
    return F.regexp_replace(name, "[/:]", "_")


def layers(n: Column) -> Column:
    """array<struct(tag, transformer_layer, hidden_state_index)> of the middle, three-quarter and last of n layers;
    a layer that two of them share is the earlier one's."""
    at = lambda share: F.least(F.greatest(F.ceil(n * share), F.lit(1)), n).cast("int")
    one = lambda tag, layer: F.struct(F.lit(tag).alias("tag"), layer.alias("transformer_layer"), layer.alias("hidden_state_index"))
    middle, three, last = at(0.5), at(0.75), n.cast("int")
    return F.array_compact(F.array(one("middle", middle), F.when(three != middle, one("layer_75pct", three)), F.when((last != middle) & (last != three), one("last", last))))


def decimals(c: Column, signed: bool = False, bold: Column | None = None) -> Column:
    """Three decimals, as a LaTeX cell."""
    text = F.format_string("%+.3f" if signed else "%.3f", c)
    return text if bold is None else F.when(bold, F.concat(F.lit("\\textbf{"), text, F.lit("}"))).otherwise(text)


def percent(c: Column, places: int = 1) -> Column:
    """A share as a percentage."""
    return F.format_string(f"%.{places}f%%", c * 100)


def layer_count(config, name: str = "num_hidden_layers") -> int | None:
    """A setting of a model's configuration, at the top or in the first of the configurations within that has it."""
    if not isinstance(config, dict):
        return None
    if config.get(name) is not None:
        return int(config[name])
    return next((found for value in config.values() if (found := layer_count(value, name)) is not None), None)


def redacted(c: Column) -> Column:
    """A secret setting as it may be written down."""
    return F.when(c.isNotNull() & (c != ""), "[REDACTED]").otherwise(c)
