"""A first-order fuzzy-rule scorer as Column expressions: K Gaussian rules over n inputs, each with an affine output."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions.scalars import clip, keyed_truncated_normal
from marketweave.sources.sinks import read_json, write_json


@dataclass
class FuzzyModel:
    centers: list[list[float]]
    sigmas: list[list[float]]
    consequents: list[list[float]]  # intercept first
    scale_lo: list[float] | None = None
    scale_span: list[float] | None = None
    clip_rule_outputs: bool = True
    sigma_floor: float = 1e-4
    firing_floor: float = 1e-8
    neutral: float = 50.0
    top: float = 100.0
    version: int = 4
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def n_rules(self) -> int:
        return len(self.centers)

    @property
    def n_inputs(self) -> int:
        return len(self.centers[0])

    def counts(self) -> dict[str, int]:
        """Parameters that training moves (widths and outputs), and all."""
        k, n = self.n_rules, self.n_inputs
        return {"free": k * n + k * (n + 1), "total": 3 * k * n + k}

    def save(self, path: str) -> None:
        write_json(path, asdict(self))

    @classmethod
    def load(cls, path: str) -> FuzzyModel:
        """Unknown keys are ignored and missing ones take their defaults, so older files load."""
        raw = read_json(path)
        return cls(**{k: v for k, v in raw.items() if k in cls.__dataclass_fields__})

    # Column expressions; xs are the raw input columns.
    def scaled(self, xs: list[Column]) -> list[Column]:
        if self.scale_lo is None:
            return xs
        return [(x - lo) / span for x, lo, span in zip(xs, self.scale_lo, self.scale_span, strict=True)]

    def log_firing(self, xs: list[Column]) -> list[Column]:
        xs = self.scaled(xs)
        out = []
        for c, s in zip(self.centers, self.sigmas, strict=True):
            squares = [((x - ci) / max(si, self.sigma_floor)) * ((x - ci) / max(si, self.sigma_floor)) for x, ci, si in zip(xs, c, s, strict=True)]
            out.append(-0.5 * _total(squares))
        return out

    def firing(self, xs: list[Column]) -> list[Column]:
        return [F.exp(v) for v in self.log_firing(xs)]

    def weights(self, xs: list[Column]) -> list[Column]:
        """Normalised firing, from logarithms shifted by their maximum."""
        logs = self.log_firing(xs)
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        raw = [F.exp(v - top) for v in logs]
        total = _total(raw)
        return [w / total for w in raw]

    def rule_outputs(self, xs: list[Column], clipped: bool = False) -> list[Column]:
        xs = self.scaled(xs)
        out = [_total([F.lit(b[0])] + [bi * x for bi, x in zip(b[1:], xs, strict=True)]) for b in self.consequents]
        return [clip(y, 0.0, self.top) for y in out] if clipped else out

    def predict(self, xs: list[Column]) -> Column:
        return _total([w * f for w, f in zip(self.weights(xs), self.rule_outputs(xs), strict=True)])

    def score(self, xs: list[Column]) -> Column:
        """In [0, top]; neutral where the firing of all rules together is under the floor; NULL if an input is."""
        mean = _total([w * f for w, f in zip(self.weights(xs), self.rule_outputs(xs, self.clip_rule_outputs), strict=True)])
        fired = _total(self.firing(xs))
        return F.when(fired < self.firing_floor, self.neutral).when(fired.isNotNull(), clip(mean, 0.0, self.top))

    def staged(self, df: DataFrame, inputs: list[str], clipped: bool) -> DataFrame:
        """df with _w{k} (normalised firing), _f{k} (rule outputs) and _s (all raw firing): columns of their own, so no expression is repeated."""
        xs, k_all = [F.col(c) for c in inputs], range(self.n_rules)
        df = df.withColumns({f"_g{k}": g for k, g in enumerate(self.log_firing(xs))} | {f"_f{k}": f for k, f in enumerate(self.rule_outputs(xs, clipped))})
        df = df.withColumn("_t", F.greatest(*[F.col(f"_g{k}") for k in k_all]) if self.n_rules > 1 else F.col("_g0"))
        df = df.withColumns({f"_e{k}": F.exp(F.col(f"_g{k}") - F.col("_t")) for k in k_all} | {"_s": _total([F.exp(f"_g{k}") for k in k_all])})
        df = df.withColumn("_n", _total([F.col(f"_e{k}") for k in k_all]))
        df = df.withColumns({f"_w{k}": F.col(f"_e{k}") / F.col("_n") for k in k_all})
        return df.drop("_t", "_n", *[f"_{x}{k}" for x in "ge" for k in k_all])

    def with_score(self, df: DataFrame, inputs: list[str], name: str = "score") -> DataFrame:
        own, k_all = df.columns, range(self.n_rules)
        df = self.staged(df, inputs, self.clip_rule_outputs).withColumn("_m", _total([F.col(f"_w{k}") * F.col(f"_f{k}") for k in k_all]))
        score = F.when(F.col("_s") < self.firing_floor, self.neutral).when(F.col("_s").isNotNull(), clip(F.col("_m"), 0.0, self.top))
        return df.withColumn(name, score).select(*[c for c in own if c != name], name)

    def with_prediction(self, df: DataFrame, inputs: list[str], name: str = "prediction") -> DataFrame:
        """The weighted mean of unclipped rule outputs, as training sees it."""
        df, own = self.staged(df, inputs, False), df.columns
        return df.withColumn(name, _total([F.col(f"_w{k}") * F.col(f"_f{k}") for k in range(self.n_rules)])).select(*own, name)

    def masked_score(self, xs: list[Column], noise: list[Column]) -> Column:
        """The score with raw firing multiplied by 1 + noise, no weight under 0."""
        masked = [mask_weight(w, z) for w, z in zip(self.firing(xs), noise, strict=True)]
        total = _total(masked)
        outputs = self.rule_outputs(xs, self.clip_rule_outputs)
        mean = _total([w * f for w, f in zip(masked, outputs, strict=True)]) / F.nullif(total, F.lit(0.0))
        return F.when(total > self.firing_floor, clip(mean, 0.0, self.top)).when(total.isNotNull(), self.neutral)

    def deployed_score(self, xs: list[Column], flag: Column | None, alpha: float, key: list[Column | str]) -> Column:
        """Masked where the flag is set (everywhere without a flag), as usual elsewhere and for alpha <= 0."""
        base = self.score(xs)
        if alpha <= 0:
            return base
        masked = self.masked_score(xs, [keyed_truncated_normal(alpha, [*key, str(k)]) for k in range(self.n_rules)])
        return masked if flag is None else F.when(flag > 0, masked).otherwise(base)

    def expected_masked(self, xs: list[Column], alpha: float = 0.05) -> Column:
        """First-order mean of the masked score: Y - (alpha/2)^2 * sum of w^2 (y - Y)."""
        w, f = self.weights(xs), self.rule_outputs(xs, self.clip_rule_outputs)
        mean = _total([a * b for a, b in zip(w, f, strict=True)])
        return mean - (alpha / 2) ** 2 * _total([a * a * (b - mean) for a, b in zip(w, f, strict=True)])

    def design(self, xs: list[Column]) -> list[Column]:
        """Regressors of the rule outputs: each rule's weight times (1, inputs)."""
        return [w * x for w in self.weights(xs) for x in [F.lit(1.0), *self.scaled(xs)]]


def mask_weight(w: Column, noise: Column) -> Column:
    masked = w * (1.0 + noise)
    return F.when(masked < 0, 0.0).otherwise(masked)


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out
