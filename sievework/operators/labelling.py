"""Heuristic labels of items: a query's tokens choose a regime, and the regime is a list of rules over an item's token set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planning import STOP_WORDS
from ..functions.text import tokens

#: The token sets of the regimes.
SETS: dict[str, tuple[str, ...]] = {
    "math": ("algebra", "algebraic", "automata", "coding", "entropy", "formal", "information", "math", "mathematical", "mathematics", "theory"),
    "strong_math": ("algebra", "algebraic", "automata", "formal", "math", "mathematical", "mathematics"),
    "language": ("acquisition", "grammar", "grammars", "language", "languages", "linguistic", "linguistics", "natural", "semantic", "semantics", "syntax"),
    "structural": ("algebra", "algebraic", "automata", "formal", "grammar", "grammars", "linguistic", "linguistics", "semantic", "semantics", "syntax"),
    "generic_language_model": ("chatgpt", "classroom", "education", "educational", "gpt", "homework", "llm", "llms", "model", "models", "student", "students"),
    "wrong_domain": ("biomedical", "clinical", "clinician", "clinicians", "disease", "health", "medical", "medicine", "patient", "patients"),
    "math_language_method": ("applied", "bayesian", "computational", "computer", "frequentist", "generation", "hypothesis", "linguistic", "linguistics", "machine", "methods", "morpheme", "morphological", "processing", "program", "psycholinguistics", "question", "relies", "statistical", "statistics", "techniques"),
    "maldi_amr_off_domain": ("chemical", "chiral", "clusters", "condensate", "fermions", "lattice", "magnetic", "mapping", "mri", "oxychloride", "quantitative", "quantum", "superconducting", "superconductor", "tantalum", "topological", "wilson"),
    "surveillance_off_domain": ("5g", "air", "aviation", "color", "communications", "frames", "histogram", "keyframes", "mobility", "navigation", "rgb", "tactical", "traffic", "video"),
    "clinical_stewardship": ("antibiotic", "antimicrobial", "bacterial", "biomarker", "biomarkers", "care", "clinical", "critical", "decision", "guidelines", "icu", "infection", "infections", "intensive", "management", "neonatal", "neonates", "pediatric", "procalcitonin", "pyelonephritis", "sepsis", "septic", "shock", "stewardship", "treatment"),
    "stochastic_calculus": ("brownian", "calculus", "differential", "girsanov", "integral", "integration", "ito", "martingale", "martingales", "semimartingale", "semimartingales", "stochastic", "stratonovich"),
    "stochastic_calculus_collision": ("education", "euler", "fractional", "generic", "lagrange", "newtonian", "non", "variations"),
    "simulation_package": ("api", "environment", "functions", "gymnasium", "optimization", "package", "policy", "python", "reinforcement", "reward", "simulation", "simulator"),
}
#: Fixed values.
RESISTANCE = ("antibiotic", "antibiotics", "antimicrobial", "carbapenem", "carbapenemase", "cre", "drug", "esbl", "lactamase", "resistance", "resistant")
#: Fixed values.
WARDS = ("care", "clinical", "critically", "developing", "hospital", "implications", "patients", "patterns", "prevalence", "stewardship", "surveillance", "tertiary", "uropathogens")


class Bag:
    """Conditions on an array of tokens."""

    def __init__(self, items: Column) -> None:
        self.items = items

    def any(self, *words: str) -> Column:
        return F.arrays_overlap(self.items, F.array(*[F.lit(w) for w in words]))

    def all(self, *words: str) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(w) for w in words]), self.items)) == 0

    def shared(self, words: tuple[str, ...]) -> Column:
        """The words held, sorted."""
        return F.array_intersect(F.array(*[F.lit(w) for w in sorted(words)]), self.items) if words else F.array().cast("array<string>")

    def count(self, words: tuple[str, ...]) -> Column:
        return F.size(self.shared(words))


@dataclass(frozen=True)
class Rule:
    """label where ``when`` holds (None: always); confidence = min(cap, base + step * count + relevance / divisor), or with the part of relevance under 25 where ``below``."""

    label: str
    when: Column | None
    cap: float
    base: float
    divisor: float
    rationale: str
    step: float = 0.0
    count: Column | None = None
    below: bool = False

    def outcome(self, relevance: Column) -> Column:
        part = F.greatest(F.lit(0), 25 - relevance) if self.below else relevance
        value = F.lit(self.base) + (F.lit(self.step) * self.count if self.count is not None else 0.0)
        return F.struct(F.lit(self.label).alias("label"), F.round(F.least(F.lit(self.cap), value + part / self.divisor), 3).alias("confidence"), F.lit(self.rationale).alias("rationale"))


def _math_language(t: Bag, n: Column, r: Column, provider: Column) -> list[Rule]:
    math, strong, lang, structure = (t.any(*SETS[k]) for k in ("math", "strong_math", "language", "structural"))
    chat = t.any(*SETS["generic_language_model"]) & ~structure & (r < 20)
    method = (
        (t.all("natural", "language", "processing") & t.any("computational", "question", "generation", "program", "computer", "relies", "techniques")) | t.all("computer", "program", "language")
        | (t.any("morphological") & t.any("corpus", "morpheme", "processing", "unsupervised")) | t.all("applied", "linguistics", "machine", "learning")
        | (t.any("bayesian", "frequentist", "hypothesis", "statistical", "statistics") & t.any("linguistic", "linguistics", "psycholinguistics"))
    )
    wrong = t.any(*SETS["wrong_domain"])
    return [
        Rule("irrelevant", wrong & ~(math & structure & ~chat), 0.9, 0.7, 300, "metadata is wrong-domain for mathematical language query"),
        Rule("relevant", method, 0.95, 0.68, 300, "metadata matches computational or statistical language methods", 0.04, t.count(SETS["math_language_method"])),
        Rule("relevant", math & lang & (strong | structure) & ((r >= 20) | strong) & ~chat, 0.95, 0.62, 250, "metadata matches mathematical language query terms", 0.05, n),
        Rule("maybe", lang & ~wrong, 0.78, 0.54, 350, "metadata partially matches language query terms", 0.04, n),
        Rule("maybe", math & lang, 0.78, 0.56, 350, "metadata partially matches mathematical language query terms", 0.04, n),
        Rule("irrelevant", None, 0.9, 0.7, 250, "metadata lacks mathematical language evidence", below=True),
    ]


def _stochastic(t: Bag, n: Column, r: Column, provider: Column) -> list[Rule]:
    named = t.any("brownian", "girsanov", "ito", "martingale", "martingales", "semimartingale", "semimartingales", "stratonovich")
    topic = named | (t.any("stochastic") & t.any("calculus", "differential", "equations", "integral", "integration"))
    return [
        Rule("relevant", topic, 0.95, 0.7, 300, "metadata matches stochastic-calculus topic evidence", 0.04, t.count(SETS["stochastic_calculus"])),
        Rule("irrelevant", t.any("calculus") & t.any(*SETS["stochastic_calculus_collision"]), 0.9, 0.72, 400, "metadata matches generic calculus collision without stochastic context", 0.04, t.count(SETS["stochastic_calculus_collision"])),
        Rule("maybe", (n >= 2) | (r >= 35), 0.78, 0.55, 350, "metadata partially matches stochastic-calculus query", 0.06, n),
        Rule("irrelevant", None, 0.88, 0.68, 400, "metadata lacks stochastic-calculus evidence"),
    ]


def _maldi(t: Bag, n: Column, r: Column, provider: Column) -> list[Rule]:
    resists = t.any("resistance", "resistant", "susceptibility") & t.any("antibiotic", "antibiotics", "antimicrobial", "antimicrobials")
    match = t.all("antimicrobial", "resistance") | (t.any("maldi") & resists) | (t.any("resistance") & t.any("proteins", "protein") & t.any("antimicrobial", "antibiotic", "antibiotics"))
    noise = t.any(*SETS["maldi_amr_off_domain"]) | (t.any("prescribing") & t.any("policy", "policies", "primary", "urinary"))
    spectra = t.any("maldi", "spectra", "spectrometry") & t.any("bacterial", "clinical", "isolates", "laboratories", "mass", "microbiology")
    return [
        Rule("relevant", match, 0.95, 0.72, 300, "metadata matches biomedical antimicrobial resistance evidence", 0.05, n),
        Rule("irrelevant", noise, 0.9, 0.7, 350, "metadata matches off-domain MALDI/AMR noise", 0.04, t.count(SETS["maldi_amr_off_domain"])),
        Rule("maybe", spectra, 0.78, 0.62, 350, "metadata has MALDI clinical spectra context without direct AMR evidence", 0.04, n),
        Rule("irrelevant", ~resists, 0.88, 0.76, 400, "metadata lacks biomedical antimicrobial resistance context"),
        Rule("maybe", None, 0.78, 0.55, 350, "metadata partially matches biomedical antimicrobial resistance", 0.06, n),
    ]


def _surveillance(t: Bag, n: Column, r: Column, provider: Column) -> list[Rule]:
    resists, ward = t.any(*RESISTANCE), t.any(*WARDS)
    return [
        Rule("relevant", resists & ward, 0.95, 0.72, 300, "metadata matches clinical resistance surveillance", 0.05, n),
        Rule("irrelevant", t.any(*SETS["surveillance_off_domain"]) | (t.all("beta", "lactamase") & ~ward), 0.9, 0.7, 350, "metadata lacks clinical ESBL/CRE surveillance context", 0.04, t.count(SETS["surveillance_off_domain"])),
        Rule("irrelevant", ~resists, 0.88, 0.68, 350, "metadata lacks ESBL/CRE resistance evidence"),
        Rule("maybe", None, 0.78, 0.55, 350, "metadata partially matches ESBL/CRE surveillance", 0.06, n),
    ]


def _stewardship(t: Bag, n: Column, r: Column, provider: Column) -> list[Rule]:
    packaged = t.count(SETS["simulation_package"])
    noise = (
        (packaged >= 2) | (t.all("transmission", "disease") & ~t.any("biomarker", "biomarkers", "clinical", "icu", "intensive", "procalcitonin", "sepsis", "stewardship"))
        | ((F.lower(F.coalesce(provider, F.lit(""))) == "arxiv") & t.all("sepsis", "deep", "learning") & ~t.any("antibiotic", "antimicrobial", "biomarker", "biomarkers", "guideline", "guidelines", "procalcitonin", "stewardship", "treatment"))
    )
    match = (
        (t.any("procalcitonin") & t.any("antimicrobial", "bacterial", "infection", "infections", "sepsis"))
        | (t.any("sepsis", "septic") & t.any("antibiotic", "biomarker", "biomarkers", "care", "critical", "guidelines", "icu", "intensive", "management", "shock", "treatment"))
        | (t.any("stewardship") & t.any("antibiotic", "antimicrobial") & t.any("care", "clinical", "decision", "icu", "intensive", "pediatric"))
        | (t.any("clinical") & t.any("bacterial", "infection", "infections") & t.any("gram", "negative", "neonatal", "neonates"))
        | (t.any("biomarker", "biomarkers") & t.any("clinical", "critical", "infection", "microbiological", "pyelonephritis", "sepsis"))
    )
    return [
        Rule("irrelevant", noise, 0.9, 0.7, 350, "metadata matches clinical-query noise rather than patient evidence", 0.03, packaged),
        Rule("relevant", match, 0.95, 0.72, 350, "metadata matches clinical infection, biomarker, or stewardship evidence", 0.04, t.count(SETS["clinical_stewardship"])),
        Rule("maybe", t.any("antibiotic", "antimicrobial", "sepsis", "procalcitonin", "stewardship"), 0.78, 0.55, 350, "metadata partially matches clinical stewardship query", 0.06, n),
        Rule("irrelevant", None, 0.88, 0.68, 350, "metadata lacks clinical stewardship evidence"),
    ]


def _default(t: Bag, n: Column, r: Column, provider: Column) -> list[Rule]:
    return [
        Rule("relevant", (n >= 3) | (r >= 65), 0.95, 0.62, 250, "metadata strongly matches query terms", 0.08, n),
        Rule("maybe", (n >= 2) | ((n >= 1) & (r >= 15)) | (r >= 25), 0.8, 0.55, 300, "metadata partially matches query terms", 0.07, n),
        Rule("irrelevant", None, 0.9, 0.68, 200, "metadata has little query overlap", below=True),
    ]


#: Fixed values.
CALCULUS = frozenset(("brownian", "calculus", "differential", "equations", "girsanov", "integration", "ito", "martingale", "martingales", "semimartingale", "semimartingales", "stratonovich"))
#: Regimes in order: the first whose test a query's token set passes is taken.
REGIMES: list[tuple[str, Callable[[frozenset[str]], bool], Callable[..., list[Rule]]]] = [
    ("math_language", lambda q: bool(q & set(SETS["math"]) and q & set(SETS["language"])), _math_language),
    ("stochastic_calculus", lambda q: "stochastic" in q and bool(q & CALCULUS), _stochastic),
    ("maldi_amr", lambda q: "maldi" in q and bool(q & {"antibiotic", "antimicrobial", "resistance", "susceptibility"}), _maldi),
    ("esbl_cre", lambda q: bool(q & {"cre", "esbl"}) and "surveillance" in q, _surveillance),
    ("stewardship", lambda q: bool(q & {"procalcitonin", "sepsis"} and q & {"antibiotic", "antimicrobial", "stewardship"}), _stewardship),
    ("default", lambda q: True, _default),
]


def regime(query_tokens: tuple[str, ...]) -> str:
    return next(name for name, test, _ in REGIMES if test(frozenset(query_tokens)))


def auto_label(df: DataFrame, query_tokens: tuple[str, ...]) -> DataFrame:
    """Items (title, abstract, journal, concepts, mesh_terms, provider, relevance_score) with label, confidence, rationale and signals.

    Null columns add no tokens, a null relevance counts as 0; every row gets a label. One narrow pass.
    """
    rules_of = dict((name, rules) for name, _, rules in REGIMES)[regime(query_tokens)]
    own = df.columns
    df = df.withColumn("_t", tokens(F.concat_ws(" ", "title", "abstract", "journal", "concepts", "mesh_terms"), list(STOP_WORDS)))
    bag, r = Bag(F.col("_t")), F.coalesce("relevance_score", F.lit(0))
    overlap = bag.shared(tuple(query_tokens))
    rules = rules_of(bag, F.size(overlap), r, F.col("provider"))
    chain = F.when(F.coalesce(rules[0].when, F.lit(False)), rules[0].outcome(r))
    for rule in rules[1:-1]:
        chain = chain.when(F.coalesce(rule.when, F.lit(False)), rule.outcome(r))
    listed = lambda name, found: F.concat(F.lit(f"{name}="), F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("-"))
    signals = F.concat_ws(";", listed("query_overlap", overlap), *[listed(f"{k}_overlap", bag.shared(v)) for k, v in SETS.items()], F.concat(F.lit("relevance_score="), r.cast("string")), F.concat(F.lit("provider="), F.coalesce(F.nullif("provider", F.lit("")), F.lit("unknown"))))
    out = df.withColumn("_d", chain.otherwise(rules[-1].outcome(r))).withColumn("_s", signals)
    return out.select(*[c for c in own if c not in ("label", "confidence", "rationale", "signals")], "_d.*", F.col("_s").alias("signals"))


def batch_labels(items: DataFrame, labels: DataFrame, decided: DataFrame, key: str, order: list[str], limit: int, least: float | None = None) -> DataFrame:
    """The decisions to store: of the first ``limit`` allowed items, those without a human label whose confidence reaches ``least``.

    items has ``key`` and allowed; labels has ``key`` and label_source; decided has ``key`` and confidence.
    """
    first = items.where("allowed").orderBy(*order).limit(limit).select(key)
    human = labels.where("label_source = 'human'").select(key)
    kept = decided.join(first, key, "left_semi").join(human, key, "left_anti")
    return kept.where(F.col("confidence") >= least) if least is not None else kept


def prior_agent_label(signals: Column, note: Column) -> Column:
    """struct(label, confidence) of an agent's label noted in signals or note; null where there is none, a confidence out of 0 to 1 is null."""
    text = F.concat_ws(" ", F.nullif(signals, F.lit("")), F.nullif(note, F.lit("")))
    label = F.nullif(F.lower(F.regexp_extract(text, r"(?i)agent(?:_label)?\s*=\s*(relevant|maybe|irrelevant)\b", 1)), F.lit(""))
    value = F.regexp_extract(text, r"(?i)(?:agent_)?confidence\s*=\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
    return F.when(label.isNotNull(), F.struct(label.alias("label"), F.when((value >= 0) & (value <= 1), value).alias("confidence")))
