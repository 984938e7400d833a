"""Query parsing on the driver: phrases, required, optional and negated tokens, travel intents."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from skald.functions.text import FOLD_FROM, FOLD_TO, FOLD_TWO, STOPWORDS

_FOLD = {ord(a): b for a, b in zip(FOLD_FROM, FOLD_TO, strict=True)} | {ord(a): b for a, b in FOLD_TWO.items()}
_PUNCTUATION = ",.;:!?'\""


def stem_word(t: str) -> str:
    """The stemmer for one token; the Column form is ``functions.text.stem``."""
    if len(t) <= 3:
        return t
    if t.endswith("ies") and len(t) > 4:
        return f"{t[:-3]}y"
    if t.endswith("sses"):
        return t[:-2]
    s = t[:-2] if re.search("(s|x|z|ch|sh)es$", t) else t
    s = s[:-1] if len(s) > 3 and re.search("[^s]s$", s) else s
    for ending, least in (("ing", 5), ("ed", 4)):
        if s.endswith(ending) and len(s) > least:
            base = s[: -len(ending)]
            return base[:-1] if base[-1:] == base[-2:-1] else base
    return s


def tokens(text: str) -> list[str]:
    """English tokens of a query text."""
    folded = re.sub("[^a-zA-Z0-9]", " ", text.replace("İ", "i").lower().translate(_FOLD))
    return [s for w in folded.split() if len(w) >= 2 and w not in STOPWORDS and (s := stem_word(w))]


def _following(words: list[str], keys: tuple[str, ...], start: int = 0) -> tuple[str, int]:
    at = next((i for i in range(start, len(words) - 1) if words[i] in keys), None)
    return ("", -1) if at is None else (words[at + 1].strip(_PUNCTUATION), at)


@dataclass
class Parsed:
    text: str
    required: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    negated: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    intents: list[tuple[list[str], list[str], float]] = field(default_factory=list)
    """Each intent: any of these words, all of these words, boost."""

    @property
    def scored(self) -> list[str]:
        return sorted({*self.required, *self.optional}) or sorted(set(tokens(re.sub('"[^"]*("|$)', "", self.text))))


def parse(q: str) -> Parsed:
    """Operators are sticky and act on what follows; NOT makes optional, only a leading minus negates."""
    out = Parsed(q, phrases=re.findall('"([^"]*)"', q))
    operator, sets = "and", {"required": set(), "optional": set(), "negated": set()}
    for word in re.sub('"[^"]*("|$)', "", q).lower().split():
        if word in ("and", "or", "not"):
            operator = word
            continue
        found = tokens(word.removeprefix("-"))
        if found:
            sets["negated" if word.startswith("-") else "required" if operator == "and" else "optional"].add(found[0])
    out.required, out.optional, out.negated = (sorted(sets[k]) for k in ("required", "optional", "negated"))
    out.intents = intents(q)
    return out


# Fixed values inside: the cue phrases, the words that texts are searched for, the boosts.
def intents(q: str) -> list[tuple[list[str], list[str], float]]:
    qn = q.strip().lower()
    words, found = qn.split(), []
    if any(cue in qn for cue in ("flights to ", "flight to ", "airfare to ", "tickets to ")):
        city, _ = _following(words, ("to",))
        if city:
            found.append((["flight", "airline", "airfare", "ticket"], [city], 1.2))
    if "flights from " in qn and " to " in qn:
        origin, at = _following(words, ("from",))
        target, _ = _following(words, ("to",), at + 2) if at >= 0 else ("", -1)
        if origin and target:
            found.append((["flight"], [origin, target], 1.3))
    if any(cue in qn for cue in ("hotels in ", "hotel in ", "accommodation in ", "lodging in ", "stay in ", "hotels near ", "hotel near ")):
        place, _ = _following(words, ("in", "near"))
        if place:
            found.append((["hotel", "accommodation", "lodging", "stay"], [place], 1.0))
    return found
