"""The direction experiments as a table, and the training views each one derives from the same blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palinode.functions.math import objective_weight
from palinode.functions.sequences import bridge_io, corrupt, ids_digest, k_step_targets, lm_io, mixed_direction_io
from palinode.functions.tokens import LAB_SPECIALS

SCHEMA = ("name string, primary_direction int, reverse_weight double, bridge_weight double, mtp_weight double, "
          "mtp_k int, intermediate_weight double, latent_weight double, align_weight double, "
          "layerpred_weight double, rtd_weight double, reverse_mix_prob double, use_direction_token boolean, "
          "use_direction_emb boolean, use_adapters boolean, anneal_reverse boolean")

# The experiment catalogue. Every experiment has these values unless its row says otherwise.
DEFAULTS = {
    "primary_direction": 0,
    "reverse_weight": 0.0,
    "bridge_weight": 0.0,
    "mtp_weight": 0.0,
    "mtp_k": 2,
    "intermediate_weight": 0.0,
    "latent_weight": 0.0,
    "align_weight": 0.0,
    "layerpred_weight": 0.0,
    "rtd_weight": 0.0,
    "reverse_mix_prob": 0.0,
    "use_direction_token": False,
    "use_direction_emb": False,
    "use_adapters": False,
    "anneal_reverse": True,
}

# The experiments and where they differ from DEFAULTS.
EXPERIMENTS = {
    "forward_only": {},
    "reverse_only": {"primary_direction": 1},
    "reverse_mtp2_low": {"primary_direction": 1, "mtp_weight": 0.04},
    "fwd_token_only": {"use_direction_token": True},
    "direction_token_rev002": {"reverse_weight": 0.02, "use_direction_token": True},
    "direction_token_rev004": {"reverse_weight": 0.04, "use_direction_token": True},
    "direction_token_rev006": {"reverse_weight": 0.06, "use_direction_token": True},
    "direction_token_rev008": {"reverse_weight": 0.08, "use_direction_token": True},
    "direction_token_rev012": {"reverse_weight": 0.12, "use_direction_token": True},
    "direction_token_exit_low": {"reverse_weight": 0.08, "intermediate_weight": 0.03, "use_direction_token": True},
    "direction_token_mtp2_low": {"reverse_weight": 0.08, "mtp_weight": 0.04, "use_direction_token": True},
    "direction_mix_p05": {"reverse_mix_prob": 0.05, "use_direction_token": True},
    "direction_mix_p10": {"reverse_mix_prob": 0.1, "use_direction_token": True},
    "direction_mix_p20": {"reverse_mix_prob": 0.2, "use_direction_token": True},
    "naive_reverse": {"reverse_weight": 0.35, "anneal_reverse": False},
    "direction_token": {"reverse_weight": 0.35, "use_direction_token": True, "anneal_reverse": False},
    "direction_embedding": {"reverse_weight": 0.35, "use_direction_emb": True, "anneal_reverse": False},
    "reverse_low": {"reverse_weight": 0.08},
    "direction_token_low": {"reverse_weight": 0.08, "use_direction_token": True},
    "direction_embedding_low": {"reverse_weight": 0.08, "use_direction_emb": True},
    "dir_adapter_reverse_low": {"reverse_weight": 0.08, "use_direction_emb": True, "use_adapters": True},
    "mtp2_only_low": {"mtp_weight": 0.04},
    "exit_only_low": {"intermediate_weight": 0.03},
    "direction_embedding_mtp2_low": {"reverse_weight": 0.08, "mtp_weight": 0.04, "use_direction_emb": True},
    "dir_adapter_reverse": {"reverse_weight": 0.35, "use_direction_emb": True, "use_adapters": True},
    "mirror_bridge": {"reverse_weight": 0.35, "bridge_weight": 0.1, "use_direction_emb": True, "use_adapters": True},
    "mirror_bridge_low": {"reverse_weight": 0.08, "bridge_weight": 0.02, "use_direction_emb": True, "use_adapters": True},
    "mirror_bridge_exit_low": {
        "reverse_weight": 0.08, "bridge_weight": 0.02, "intermediate_weight": 0.03, "use_direction_emb": True,
        "use_adapters": True},
    "mirror_bridge_mtp2_low": {
        "reverse_weight": 0.08, "bridge_weight": 0.02, "mtp_weight": 0.04, "use_direction_emb": True,
        "use_adapters": True},
    "mirror_bridge_mtp2": {
        "reverse_weight": 0.35, "bridge_weight": 0.1, "mtp_weight": 0.08, "use_direction_emb": True,
        "use_adapters": True},
    "mirror_bridge_mtp4": {
        "reverse_weight": 0.35, "bridge_weight": 0.1, "mtp_weight": 0.1, "mtp_k": 4, "use_direction_emb": True,
        "use_adapters": True},
    "mirror_bridge_exit": {
        "reverse_weight": 0.35, "bridge_weight": 0.1, "intermediate_weight": 0.06, "use_direction_emb": True,
        "use_adapters": True},
    "mirror_bridge_latent": {
        "reverse_weight": 0.35, "bridge_weight": 0.1, "latent_weight": 0.05, "use_direction_emb": True,
        "use_adapters": True},
    "mirror_bridge_align": {
        "reverse_weight": 0.35, "bridge_weight": 0.1, "align_weight": 0.03, "use_direction_emb": True,
        "use_adapters": True},
    "mirror_bridge_layerpred": {
        "reverse_weight": 0.35, "bridge_weight": 0.1, "layerpred_weight": 0.05, "use_direction_emb": True,
        "use_adapters": True},
    "mirror_bridge_rtd": {
        "reverse_weight": 0.35, "bridge_weight": 0.1, "rtd_weight": 0.08, "use_direction_emb": True,
        "use_adapters": True},
    "mirror_full_light": {
        "reverse_weight": 0.3, "bridge_weight": 0.08, "mtp_weight": 0.05, "intermediate_weight": 0.03,
        "latent_weight": 0.03, "use_direction_emb": True, "use_adapters": True},
}

# Named selections of experiments.
PRESETS = {
    "tiny": (
        "forward_only", "reverse_only", "naive_reverse", "mirror_bridge_mtp2",
    ),
    "quick": (
        "forward_only", "naive_reverse", "direction_token", "direction_embedding", "mirror_bridge",
        "mirror_bridge_mtp2", "mirror_bridge_exit", "mirror_bridge_latent", "mirror_full_light",
    ),
    "diagnostic": (
        "forward_only", "fwd_token_only", "direction_token", "direction_token_low", "reverse_low",
        "direction_embedding_low", "dir_adapter_reverse_low", "mtp2_only_low", "exit_only_low",
        "direction_token_exit_low", "direction_token_mtp2_low", "mirror_bridge_low", "mirror_bridge_exit_low",
        "mirror_bridge_mtp2_low", "direction_embedding_mtp2_low",
    ),
    "isolate": (
        "forward_only", "fwd_token_only", "direction_token_rev002", "direction_token_rev004",
        "direction_token_rev006", "direction_token_rev008", "direction_token_rev012", "exit_only_low",
        "mtp2_only_low", "direction_token_exit_low", "direction_token_mtp2_low",
    ),
    "fair_compute": (
        "forward_only", "fwd_token_only", "direction_mix_p05", "direction_mix_p10", "direction_mix_p20",
        "direction_token_rev004", "direction_token_rev008",
    ),
}


def specs(preset: str = "full") -> list[dict]:
    names = EXPERIMENTS if preset == "full" else PRESETS[preset]
    return [{"name": name, **DEFAULTS, **EXPERIMENTS[name]} for name in names]


def experiments_table(spark: SparkSession, preset: str = "full") -> DataFrame:
    return spark.createDataFrame([tuple(s.values()) for s in specs(preset)], SCHEMA)


def experiment_views(blocks: DataFrame, spec: dict, step: Column, total_steps: int, vocab_size: int,
                     row_id: str = "block_id", tokens: str = "tokens", seed: int = 0, rtd_prob: float = 0.15,
                     max_mtp_k: int = 4) -> DataFrame:
    """(row_id, objective, inputs, labels, weight): the training rows one experiment makes of a block.

    Objectives: primary, reverse, mixed, bridge (inputs are left,right pairs), mtp<k>, rtd. The hidden-state
    objectives need a model and have no rows. One scan of the blocks, one row per objective.
    """
    block, rid = F.col(tokens), F.col(row_id)
    fwd, rev = LAB_SPECIALS["<fwd>"], LAB_SPECIALS["<rev>"]
    token = spec["use_direction_token"]
    views: list[tuple[str, Column, Column, Column]] = []

    def add(name: str, inputs: Column, labels: Column, weight: Column) -> None:
        views.append((name, inputs, labels, weight.cast("double")))

    if spec["reverse_mix_prob"] > 0:
        if not token:
            raise ValueError("a direction mixture needs direction tokens")
        inputs, labels, _ = mixed_direction_io(block, rid, spec["reverse_mix_prob"], fwd, rev, seed)
        add("mixed", inputs, labels, F.lit(1.0))
    else:
        primary_rev = spec["primary_direction"] == 1
        lead = (rev if primary_rev else fwd) if token else None
        add("primary", *lm_io(block, primary_rev, lead), F.lit(1.0))
        w_rev = objective_weight(spec["reverse_weight"], step, total_steps,
                                 "reverse_anneal" if spec["anneal_reverse"] else "constant")
        if spec["reverse_weight"] > 0 and not primary_rev:
            add("reverse", *lm_io(block, True, rev if token else None), w_rev)
        if spec["bridge_weight"] > 0 and not token:
            add("bridge", *bridge_io(block), F.lit(spec["bridge_weight"]))
        if spec["mtp_weight"] > 0:
            seq = F.reverse(block) if primary_rev else block
            w = objective_weight(spec["mtp_weight"], step, total_steps, "mtp_ramp")
            ks = range(2, min(spec["mtp_k"], max_mtp_k) + 1)
            base = lm_io(block, primary_rev, lead)[0]
            for k in ks:
                labels = k_step_targets(seq, k, token)
                add(f"mtp{k}", F.slice(base, F.lit(1), F.size(labels)), labels, w / len(ks))
        if spec["rtd_weight"] > 0:
            inputs, labels = corrupt(lm_io(block)[0], rid, rtd_prob, len(LAB_SPECIALS), vocab_size, seed)
            add("rtd", inputs, labels, F.lit(spec["rtd_weight"]))
    packed = F.array(*[F.struct(F.lit(n).alias("objective"), i.alias("inputs"), l.alias("labels"), w.alias("weight"))
                       for n, i, l, w in views])
    return blocks.select(row_id, F.inline(packed)).where(F.col("weight") > 0)


def view_digest(views: DataFrame) -> DataFrame:
    """Comparable form of views: id text digests instead of arrays."""
    return views.withColumns({"inputs": ids_digest(F.col("inputs")), "labels": ids_digest(F.col("labels"))})
