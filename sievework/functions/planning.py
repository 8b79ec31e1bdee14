"""Query understanding: what a query asks for, as literals that the plans of the operators take.

A query is one short text, so its plan is made on the driver; ``normalize_query`` also has a column form for tables of queries.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings of a spoken request, of which the first that matches goes.
OPENINGS = (
    r"tell\s+me\s+about\s+", r"tell\s+me\s+", r"can\s+you\s+tell\s+me\s+about\s+", r"can\s+you\s+tell\s+me\s+",
    r"give\s+me\s+(?:a\s+)?(?:report|summary|overview)\s+(?:about|on|of)\s+", r"write\s+(?:a\s+)?(?:report|summary|overview)\s+(?:about|on|of)\s+",
    r"summarize\s+", r"explain\s+", r"what\s+(?:is|are|was|were)\s+(?:the\s+)?", r"what['’]s\s+(?:the\s+)?",
)
#: Words left out of topic terms.
STOP_TERMS = ("about", "after", "analysis", "and", "are", "based", "for", "from", "how", "into", "paper", "study", "the", "this", "using", "with")
#: Words left out of item and query tokens.
STOP_WORDS = ("a", "an", "and", "about", "are", "as", "at", "by", "can", "describe", "does", "explain", "for", "from", "how", "important", "importance", "in", "into", "is", "me", "of", "on", "or", "tell", "the", "to", "using", "what", "why", "with")
#: Words that together make a query one of mathematics and language, and what it is expanded to.
MATH = ("math", "mathematics", "mathematical", "computation", "computational", "formal", "algebra", "automata", "information", "entropy")
LANGUAGE = ("language", "languages", "linguistic", "linguistics", "grammar", "grammars", "syntax", "semantic", "semantics")
MATH_LANGUAGE_QUERIES = ("mathematical linguistics", "formal language theory natural language", "information theory language", "mathematical models of language acquisition")
#: Intents, the strongest first.
INTENTS = ("biomedical", "nlp", "ml", "computational")

#: Words that speak for a sense of an acronym.
BIOMEDICAL = (
    "assay", "antibiotic", "antifungal", "antimicrobial", "bacteria", "bacterial", "beta lactamase", "biomarker", "carbapenem", "clinical", "diagnostic", "drug resistance", "extended spectrum", "infection", "isolate",
    "isolates", "maldi", "maldi tof", "microbial", "pathogen", "pseudomonas", "resistance", "resistant", "sensitivity", "spectra", "spectrometry", "susceptibility", "surveillance",
)
NLP = ("generation", "graph", "graphs", "language", "meaning representation", "natural language", "nlp", "parsing", "parser", "semantic", "semantics", "text")
COMPUTATIONAL = ("adaptive", "finite", "grid", "mesh", "refinement", "simulation", "solver", "timestepping")
ML = ("classification", "classifier", "computer vision", "deep learning", "feature", "features", "image", "learning", "machine learning", "model", "neural", "network", "prediction", "selection", "supervised")


@dataclass(frozen=True)
class Sense:
    """A meaning of an acronym. One that ``needs`` context counts only beside a context word; a silent one is never reported."""

    meaning: str
    intent: str
    context: tuple[str, ...] = ()
    needs: bool = False
    silent: bool = False


#: Known acronyms and their senses, the default one first.
ACRONYMS: dict[str, tuple[Sense, ...]] = {
    "AMR": (Sense("antimicrobial resistance", "biomedical", BIOMEDICAL), Sense("abstract meaning representation", "nlp", NLP), Sense("adaptive mesh refinement", "computational", COMPUTATIONAL)),
    "AST": (Sense("antimicrobial susceptibility testing", "biomedical", BIOMEDICAL, needs=True),),
    "CNN": (Sense("convolutional neural network", "ml", ML),),
    "CRE": (Sense("carbapenem-resistant Enterobacteriaceae", "biomedical", BIOMEDICAL),),
    "ESBL": (Sense("extended-spectrum beta-lactamase", "biomedical", BIOMEDICAL),),
    "LLM": (Sense("large language model", "nlp", NLP + ML),),
    "MALDI": (Sense("matrix-assisted laser desorption/ionization", "biomedical", BIOMEDICAL, silent=True),),
    "MDR": (Sense("multidrug resistance", "biomedical", BIOMEDICAL, needs=True),),
    "MIC": (Sense("minimum inhibitory concentration", "biomedical", BIOMEDICAL, needs=True),),
    "NLP": (Sense("natural language processing", "nlp", NLP + ML),),
    "PCR": (Sense("polymerase chain reaction", "biomedical", BIOMEDICAL),),
    "SVM": (Sense("support vector machine", "ml", ML),),
    "TOF": (Sense("time of flight", "biomedical", BIOMEDICAL, silent=True),),
}
#: Further queries by the meaning chosen, for queries with and without a word.
FURTHER = {"antimicrobial resistance": ("MALDI", ("MALDI-TOF antibiotic resistance", "MALDI-TOF antimicrobial susceptibility"), ("antimicrobial resistance", "antibiotic resistance"))}


@dataclass(frozen=True)
class Resolved:
    acronym: str
    meaning: str
    intent: str
    reason: str
    rejected: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    query: str
    intent: str
    queries: tuple[str, ...]
    resolved: tuple[Resolved, ...] = ()

    def rendered(self) -> str | None:
        """The acronyms with their meanings in one line; None if there are none."""
        return "; ".join(f"{r.acronym}={'unresolved' if r.intent == 'unknown' else r.meaning}" for r in self.resolved) or None


@dataclass(frozen=True)
class Topic:
    """Terms of a topic; ``components`` are the term lists of the topics it is made of."""

    query: str = ""
    profile_id: str = "unknown"
    domain: str = "unknown"
    match: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    core: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    searches: tuple[str, ...] = ()
    preferences: tuple[str, ...] = ()
    hint: str | None = None
    components: dict[str, tuple[str, ...]] = field(default_factory=dict)
    needed: tuple[str, ...] = ()


def squeeze(s: str) -> str:
    return " ".join(s.split())


def phrase(s: str) -> str:
    return re.sub("[^a-z0-9]+", " ", s.lower()).strip()


def holds(normalized: str, term: str) -> bool:
    return f" {phrase(term)} " in f" {normalized} "


def unique(values: Iterable[str | None]) -> tuple[str, ...]:
    """Squeezed values, the first of those equal but for case; empty ones go."""
    first: dict[str, str] = {}
    for v in values:
        if v is not None and squeeze(str(v)):
            first.setdefault(squeeze(str(v)).lower(), squeeze(str(v)))
    return tuple(first.values())


def normalize_query(query: str, names: tuple[str, ...] = ("assistant",)) -> str:
    """A request without the assistant's name and its opening; the request itself if nothing is left."""
    whole = squeeze(query)
    bare = re.sub(rf"(?i)^\s*(?:{'|'.join(map(re.escape, names))})\b[\s,:-]*", "", whole).strip()
    for opening in OPENINGS:
        shorter = re.sub(rf"(?i)^\s*{opening}", "", bare).strip()
        if shorter != bare:
            return shorter or whole
    return bare or whole


def normalize_query_column(query: Column, names: tuple[str, ...] = ("assistant",)) -> Column:
    """``normalize_query`` of every row: the openings are tried in order, so the first that matches decides."""
    whole = F.trim(F.regexp_replace(query, r"\s+", " "))
    bare = F.trim(F.regexp_replace(whole, rf"(?i)^(?:{'|'.join(map(re.escape, names))})\b[\s,:-]*", ""))
    chain = F.when(bare.isNull(), bare)
    for opening in OPENINGS:
        chain = chain.when(bare.rlike(f"(?i)^{opening}"), F.trim(F.regexp_replace(bare, f"(?i)^{opening}", "")))
    return F.coalesce(F.nullif(chain.otherwise(bare), F.lit("")), whole)


def resolve(query: str, acronyms: dict[str, tuple[Sense, ...]] = ACRONYMS) -> tuple[Resolved, ...]:
    """The acronyms of a query in order, each with the sense that its words speak for most."""
    words = [w for w in re.findall(r"\b[A-Za-z][A-Za-z0-9]{1,7}\b", query) if sum(c.isupper() for c in w) >= 2]
    first: dict[str, str] = {}
    for w in words:
        first.setdefault(w.upper(), w)
    text, out = phrase(query), []
    for key, word in first.items():
        senses = [s for s in acronyms.get(key, ()) if not s.silent]
        if key in acronyms and not senses:
            continue
        votes = {s.meaning: sum(holds(text, c) for c in s.context) for s in senses}
        best = max(senses, key=lambda s: votes[s.meaning], default=None)
        if best is None or best.needs and not votes[best.meaning]:
            out.append(Resolved(word, word, "unknown", "unresolved_acronym"))
            continue
        voted = votes[best.meaning] > 0 and (len(senses) > 1 or best.needs)
        reason = "context_match" if voted else "registry_default" if len(senses) > 1 else "registry_single_sense"
        out.append(Resolved(key, best.meaning, best.intent, reason, tuple(s.meaning for s in senses if s is not best)))
    return tuple(out)


def load_topics(folder: str | Path) -> list[Topic]:
    """Topics of a folder of JSON profiles, by file name. Term fields are lists, maps (their keys) or one string."""

    def terms(v) -> tuple[str, ...]:
        return tuple(str(x) for x in ([v] if isinstance(v, str) else v or ()) if str(x).strip())

    out = []
    for file in sorted(Path(folder).glob("*.json")):
        p = json.loads(file.read_text(encoding="utf-8"))
        match, core, positive = (terms(p.get(k)) for k in ("match_terms", "core_terms", "positive_terms"))
        out.append(Topic("", p["profile_id"], p.get("domain") or "unknown", match, terms(p.get("required_terms")), core, positive, terms(p.get("negative_terms")), terms(p.get("search_queries")), terms(p.get("source_preferences")), p.get("evidence_policy_hint") or None, {p["profile_id"]: unique(core + positive + match)}, (p["profile_id"],)))
    return out


def match_score(query: str, topic: Topic) -> int:
    """4 if all required terms are found (and there are some), 2 for each match term (core terms if none are given)."""
    text = phrase(query)
    return 4 * bool(topic.required and all(holds(text, t) for t in topic.required)) + 2 * sum(holds(text, t) for t in topic.match or topic.core)


def compose(query: str, topics: list[Topic]) -> Topic:
    """One topic of several: ordered unions of their terms; a topic is needed if the query names one of its match or core terms."""
    if not topics:
        return Topic(query, core=(query,) if query else (), searches=(query,) if query else ())
    text = phrase(query)
    merged = {k: unique(t for p in topics for t in getattr(p, k)) for k in ("match", "required", "core", "positive", "negative", "preferences")}
    components = {k: v for p in reversed(topics) for k, v in p.components.items() if v}
    return Topic(
        query, "composed." + "+".join(p.profile_id for p in topics), "+".join(unique(p.domain for p in topics if p.domain != "unknown")), **merged,
        searches=unique([query, *(s for p in topics for s in p.searches)]), hint="+".join(unique(p.hint for p in topics)) or None,
        components={p: components[p] for t in topics for p in t.components if p in components}, needed=tuple(p.profile_id for p in topics if any(holds(text, t) for t in p.match + p.core)),
    )


def plan_topic(query: str, topics: list[Topic]) -> Topic:
    query = squeeze(query)
    return compose(query, [t for t in topics if match_score(query, t) > 0])


def focus_terms(query: str) -> tuple[str, ...]:
    """Two- and three-word phrases, then words, of a query's own terms."""
    words = [w for w in re.findall("[A-Za-z][A-Za-z0-9-]*", query) if len(w) >= 3 and w.lower() not in STOP_TERMS]
    return unique([" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)] + words)


def plan_query(query: str, topics: list[Topic] = (), names: tuple[str, ...] = ("assistant",)) -> Plan:
    """Intent and expanded queries: by acronyms, else as a query of mathematics and language, else by topics."""
    asked = normalize_query(query, names)
    resolved = resolve(asked)
    if not resolved:
        text = phrase(asked)
        if any(holds(text, w) for w in MATH) and any(holds(text, w) for w in LANGUAGE):
            return Plan(asked, "mathematical_linguistics", MATH_LANGUAGE_QUERIES)
        topic = plan_topic(asked, list(topics))
        return Plan(asked, topic.domain, topic.searches if topic.domain != "unknown" else (asked,))
    intent = next((i for i in INTENTS if any(r.intent == i for r in resolved)), "unknown")
    spelled, queries = asked, []
    for r in resolved:
        if r.intent != "unknown":
            spelled = re.sub(rf"(?i)\b{re.escape(r.acronym)}\b", lambda _, m=r.meaning: m, spelled)
            if r.acronym == "AMR" and r.intent == intent:
                word, having, lacking = FURTHER.get(r.meaning, ("", (), (re.sub(r"(?i)\bAMR\b", r.meaning, asked),)))
                queries += having if word and re.search(rf"(?i)\b{word}\b", asked) else lacking
    return Plan(asked, intent, unique([spelled, *queries]), resolved)


def query_tokens(plan: Plan, query: str, stop: tuple[str, ...] = STOP_WORDS) -> tuple[str, ...]:
    """Sorted tokens of a query and its expansions, with the synonyms of mathematics and language."""
    found = {w for w in re.findall("[a-z0-9]+", " ".join((query, *plan.queries)).lower()) if len(w) > 2 and w not in stop}
    more = {"math", "mathematics", "mathematical", "algebra", "formal"} if found & {"math", "mathematics", "mathematical"} else set()
    more |= {"language", "linguistic", "syntax", "grammar", "grammars"} if "language" in found else set()
    return tuple(sorted(found | more))
