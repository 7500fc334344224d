"""The tokenizer configuration catalogue."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from glyphloom.session import small_table


@dataclass(frozen=True)
class TokenizerConfig:
    name: str
    title: str
    pre_tokenizer: str
    baseline: str | None = None
    capitalize: bool = False
    repeat: bool = False
    serialize: bool = False
    split_operators: bool = False

    @property
    def factored(self) -> bool:
        return self.capitalize or self.repeat or self.serialize

    @property
    def flags(self) -> str:
        """Which operators are active: configs that share this share a dictionary."""
        on = [("c", self.capitalize), ("r", self.repeat), ("s", self.serialize)]
        return "".join(k for k, v in on if v) or "-"

    @property
    def metaspace(self) -> bool:
        return self.pre_tokenizer.startswith("metaspace")


def _family(name: str, title: str, plain_title: str, repeat_only: bool) -> list[TokenizerConfig]:
    full = dict(capitalize=True, repeat=True, serialize=True, split_operators=True)
    out = [TokenizerConfig(name, plain_title, name),
           TokenizerConfig(f"{name}_factored", f"{title} + Factoring", name, name, **full)]
    if repeat_only:
        out.append(TokenizerConfig(f"{name}_factored_repeat", f"{title} + Factoring (Repeat)",
                                   name, name, repeat=True, split_operators=True))
    return out


CATALOGUE = {c.name: c for c in [
    *_family("metaspace_split", "Metaspace + Split", "Metaspace + Split", True),
    *_family("split", "Split", "Split Only", True),
    *_family("llama", "Llama Split", "Llama Split Only", False),
    *_family("metaspace_whitespace", "Metaspace + Whitespace", "Metaspace + Whitespace", False),
    *_family("metaspace", "Metaspace", "Metaspace Only", False),
]}

# The five configurations of the vocabulary report, in report order.
REPORT_CONFIGS = ("split", "split_factored", "split_factored_repeat", "llama", "llama_factored")


def config_table(spark: SparkSession, names=None) -> DataFrame:
    """The catalogue as a small table (at most one row per configuration)."""
    rows = [(i, c.name, c.title, c.pre_tokenizer, c.baseline, c.capitalize, c.repeat,
             c.serialize, c.split_operators)
            for i, c in enumerate(CATALOGUE[n] for n in (names or CATALOGUE))]
    return small_table(spark, rows, (
        "ord int, config string, title string, pre_tokenizer string, baseline string, "
        "capitalize boolean, repeat boolean, serialize boolean, split_operators boolean"))
