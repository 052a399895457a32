"""Broken prompt-response pairs.

``pair_defects`` labels each response with the first defect that holds:

``empty``           NULL, or nothing that says anything (blank, invisible, a null word, bare marks)
``copy``            the response's tokens align with the prompt's and no explanation is added
``refusal``         a sentence aligns with a template of declining to answer
``other_language``  what is left without code, mathematics, quotations and words of
                    the prompt is not written in the expected language (English)
``truncated``       the text ends inside its last statement

Alignment. Copies: the share of the response's k-token shingles contained in
the prompt, and the longest common subsequence of both token lists relative to
the response; the overlap of the token multisets, an upper bound of the subsequence, is
taken first. The subsequence is computed on the bits of integers, 64 cells of its table a step.
Refusals: the longest common subsequence of a template with a window of a sentence,
relative to the template; it may start at any word of the template.
Languages: letter trigrams of a public sample and of the function words of 16 languages; the language
whose model explains the words best, letter by letter, wins. Other scripts count by their share of letters.

Defined results: a NULL or empty prompt makes no copy; repeated rows of an id
count once, the row with the latest version wins, ties by the greater label;
an empty table gives an empty table; other columns of the input are ignored,
so their names may clash with nothing. Texts of any length are read whole and by the same rules.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COPY_SHARE = 0.8
SHINGLE = 3
REFUSAL_SHARE = 0.8
MARGIN, EVIDENCE = 0.6, 50.0  # bits a letter, and in all, by which another language must explain the words better than the expected one
BACK_OFF = 2.0  # occurrences that a shorter run of letters counts for

# What declining to answer looks like, in normalised words.
REFUSALS = [
    "sorry but i can not",
    "i am sorry i can not",
    "i will not be able to",
    "sorry i am not able to",
    "that is something i can not do",
    "i must decline to",
    "i have to decline",
    "i decline to answer",
    "i am not comfortable",
    "i can not provide",
    "i can not help with",
    "i can not assist with",
    "i can not comment on",
    "i can not discuss",
    "i can not answer",
    "unable to help with this request",
    "this question falls outside what i may",
    "this request falls outside what i may",
    "not be appropriate for me to",
    "my guidelines do not allow it",
    "my guidelines do not permit",
    "against my guidelines",
    "no explanation can be given by me",
    "as an automated assistant i am",
    "as an ai language model i",
    "as an ai i can not",
    "i am not able to judge",
    "i am unable to",
    "i do not have the ability to",
    "i do not feel qualified to",
    "i will not write a reflection on",
    "i will not offer",
    "i would rather not",
    "i prefer not to answer",
    "i refuse to",
]

# Words standing for no value.
NOTHING = {"", "none", "null", "nil", "nan", "na", "n a", "undefined", "empty", "tbd", "todo", "no answer", "no reflection", "no comment"}

# Articles, pronouns, prepositions, conjunctions and auxiliaries by language; "en" is the expected one.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for as with on not are be this by from at or an was which but has have its so then only into after under does one such these if here there no when since because against over can cannot",
    "de": "der die das und nicht ist ein eine mit für auf den dem des im zu wird weil dort denn durch man hier sondern sich vom zur als auch bei oder wenn muss dieser diese an von",
    "fr": "le la les des et ne pas est une un du en pour que qui dans sur par au avec il car cette ce se plus mais où elle sont donc puis",
    "es": "el la los las de y no es un una del en para que por con se al lo como más pero porque este esta ante está hay sino",
    "it": "il lo gli le di e non è un una del della in per che con si al ma perché questo questa dove nel alla",
    "pt": "o os as de e não é um uma do da em para que por com se ao mas porque este esta onde no na",
    "pl": "i w nie na się z do jest to że przy ponieważ tam ale o od za jak po dla",
    "nl": "de het een en niet is van in op te dat voor met zijn om maar omdat deze dit er aan bij naar",
    "sv": "och att det som en ett är inte på för av med till den om men eftersom här där",
    "cs": "a v ne na se z do je to že při protože tam ale o od za jak po pro",
    "tr": "ve bir bu için ile değil da de çünkü ama olarak daha",
    "ro": "și în nu este un o de la cu pe că pentru din care sau dar deoarece",
    "fi": "ja ei on se että joka kun mutta koska tämä ovat",
    "hu": "a az és nem hogy van egy de mert ez ahol",
    "vi": "và là không của trong cho các với một này được",
    "id": "dan yang tidak di dengan untuk ini itu karena pada dari adalah",
}

# A public sample of each language, the first article of the Universal Declaration of Human Rights.
SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
}

_INVISIBLE = re.compile("[​-‏‪-‮⁠﻿­]")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_PLAIN_WORD = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|“[^”]*”|«[^»]*»|「[^」]*」", re.S)
_QUOTED = re.compile(r"\"[^\"\n]*\"")
_MATH = re.compile(r"\S*[^\W\d_]\w*\.\w\S*|\S*[_⊢∀∃∈∪∩⊆≤≥≠≈∣∧∨¬→←↔•⟨⟩\[\]{}|=<>+*/^\\:?…0-9]\S*|\b\w\b")
_LEAD = re.compile(r"^[\s>\"'“”`*_#-]*(?:(?:here is|this is|the|full|an|its|my)\s+)*(?:error|message|output|reply|lean|checker|prover)(?:\s+(?:error|message|output|reply|text))*(?:\s+(?:is|was|reads|says|said|reported|given|of the checker))*\s*:\s*", re.I)
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_FENCE = re.compile(r"^\s*```[^\n]*\n|\n?```\s*$")
_LABELLED = re.compile(r"(?:^|\n)[^\n`]{1,60}:\s*`[^`\n]*`$")
_CLOSERS = "\"'”’»)]）」*_"
_ENDS = ".!?。！？∎□■؟।"
#: A capitalised word before the last full stop that does not open its sentence; cut names end like this.
_BARE_HEAD = re.compile(r"[^\s.!?]\s+[(`\"']?((?:[A-Z][a-z]+\.)*[A-Z][a-z]+)\.$")
_DOTTED = re.compile(r"(?<![\w.])[A-Z][a-z]+\.\w")
_CONTRACTIONS = [("can't", "can not"), ("cannot", "can not"), ("won't", "will not"), ("n't", " not"), ("i'm", "i am"), ("i'd", "i would"), ("i'll", "i will"), ("i've", "i have"), ("that's", "that is"), ("it's", "it is")]


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; the rows of the table are bits of one integer."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = row & places.get(y, 0)
        if m:
            row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def says_nothing(text: str | None) -> bool:
    if text is None:
        return True
    words = [m.group(0).lower() for m, _ in zip(_PLAIN_WORD.finditer(_INVISIBLE.sub("", text)), range(4))]
    return " ".join(words) in NOTHING


def is_copy(prompt: str | None, response: str) -> bool:
    """True where the response gives back the prompt, perhaps quoted, led in, recased or repeated."""
    if not prompt:
        return False
    p = [t.lower() for t in re.findall(r"\w+", prompt)]
    r = [t.lower() for t in re.findall(r"\w+", _LEAD.sub("", response))]
    if not p or not r:
        return False
    counts = Counter(p)
    if sum(t not in counts for t in r) > (1 - COPY_SHARE) * len(r):
        return False
    k = min(SHINGLE, len(p), len(r))
    # a prompt given back several times goes on from its end to its start
    ring = p + p[: k - 1]
    grams = {tuple(ring[i : i + k]) for i in range(len(p))}
    own = [tuple(r[i : i + k]) for i in range(len(r) - k + 1)]
    if sum(g in grams for g in own) >= COPY_SHARE * len(own):
        return True
    # no subsequence is longer than the overlap of the multisets
    return (counts & Counter(r)).total() >= COPY_SHARE * len(r) and _lcs(p, r) >= COPY_SHARE * len(r)


def _plain(sentence: str) -> list[str]:
    s = sentence.lower().replace("’", "'")
    for a, b in _CONTRACTIONS:
        s = s.replace(a, b)
    return re.findall(r"[a-z]+", s)


_REFUSALS = [t.split() for t in REFUSALS]
_REFUSAL_GATE = re.compile(r"\b(?:I|[Mm]e|[Mm]y|[Uu]nable|[Ss]orry)\b")


def is_refusal(response: str) -> bool:
    """True where a sentence holds a refusal template nearly whole and nearly unbroken."""
    if not _REFUSAL_GATE.search(response):
        return False
    for sentence in _SENTENCE.split(_CODE.sub(" ", response)):
        if not _REFUSAL_GATE.search(sentence):
            continue
        words = _plain(sentence)
        have = set(words)
        for template in _REFUSALS:
            if sum(t in have for t in template) < REFUSAL_SHARE * len(template):
                continue
            span = len(template) + 2
            for i in range(max(1, len(words) - len(template) + 1)):
                if words[i] in template and _lcs(template, words[i : i + span]) >= max(REFUSAL_SHARE * len(template), min(3, len(template))):
                    return True
    return False


def foreign(prompt: str | None, response: str) -> bool:
    """True where the explanation itself is written in another language."""
    if not _NON_LATIN.search(response):
        own = other = 0
        for t in response.split():
            if t in _OWN:
                own += 1
            elif t in _OTHERS:
                other += 1
        if own >= 6 and own >= 3 * other:
            return False
    bare = _QUOTED.sub(" ", _CODE.sub(" ", response))
    bare = re.sub(r"⊢[^.;。！!?]*?(?=[;。]|\s+[^\W\d_]{2,}\s+[^\W\d_]{2,}|[.!?](?:\s|$)|$)", " ", bare)
    given = set(_WORD.findall(prompt.lower())) if prompt else set()
    letters = other = 0
    words: list[str] = []
    for w in _WORD.findall(_MATH.sub(" ", bare)):
        low = w.lower()
        if low in given:
            continue
        n = sum(1 for c in w if ord(c) > 0x370 and c.isalpha() and not 0x370 <= ord(c) < 0x400 and not 0x1D00 <= ord(c) < 0x2E80)
        letters += len(w)
        if 2 * n > len(w):
            other += len(w) * (3 if ord(w[0]) > 0x2E80 else 1)
            letters += len(w) * 2 if ord(w[0]) > 0x2E80 else 0
        else:
            words.append(low)
    if letters == 0:
        return False
    if other > 0.4 * letters:
        return True
    if len(words) < 5:
        return False
    marks = {lang: model(words) for lang, model in _MODELS.items()}
    own = marks.pop("en")
    ahead = max(marks.values()) - own
    return ahead > MARGIN and ahead * sum(len(w) + 1 for w in words) > EVIDENCE


class LetterModel:
    """Letter trigrams of a sample, backed off to bigrams and letters; gives the mean log2 likelihood of the letters of some words."""

    def __init__(self, sample: str):
        self.counts: list[Counter[str]] = [Counter(), Counter(), Counter(), Counter()]
        for w in _WORD.findall(sample.lower()):
            s = f"  {w} "
            for i in range(2, len(s)):
                for n in range(4):
                    self.counts[n][s[i - n + 1 : i + 1] if n else ""] += 1
            for i in range(2, len(s)):
                for n in (1, 2):
                    self.counts[n][s[i - n : i] + "\0"] += 1
        self.known: dict[str, float] = {}

    def _letter(self, s: str) -> float:
        p = 1 / 64
        for n in (1, 2, 3):
            before = self.counts[n - 1][s[3 - n : 2] + "\0"] if n > 1 else self.counts[0][""]
            p = (self.counts[n][s[3 - n :]] + BACK_OFF * p) / (before + BACK_OFF)
        return math.log2(p)

    def _word(self, w: str) -> float:
        s = f"  {w} "
        return sum(self._letter(s[i - 2 : i + 1]) for i in range(2, len(s)))

    def __call__(self, words: list[str]) -> float:
        total = 0.0
        if len(self.known) > 100_000:
            self.known.clear()
        for w in words:
            got = self.known.get(w)
            if got is None:
                got = self.known[w] = self._word(w)
            total += got
        return total / sum(len(w) + 1 for w in words)


_FUNCTION = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_OWN = _FUNCTION["en"]
_OTHERS = frozenset().union(*_FUNCTION.values()) - _OWN
_MODELS = {lang: LetterModel(f"{SAMPLES[lang]} {words} {words}") for lang, words in FUNCTION_WORDS.items()}
_NON_LATIN = re.compile("[Ѐ-᷿⺀-퟿豈-﷿]")


def breaks_off(prompt: str | None, response: str) -> bool:
    """True where the last statement has no end."""
    text = _INVISIBLE.sub("", response).rstrip()
    if text.startswith("```") and text.endswith("```") and len(text) > 6:
        text = _FENCE.sub("", _FENCE.sub("", text, count=1)).rstrip()
    elif text.endswith("```"):
        return text.count("```") % 2 == 1
    if not text:
        return False
    if text.endswith("`") and _LABELLED.search(text):
        return text.rstrip("`").endswith("...")
    core = text.rstrip(_CLOSERS + " ")
    if core.endswith("`"):
        return True
    if core.endswith(("...", "…")) or not core:
        return True
    if core[-1] not in _ENDS:
        return True
    last = _BARE_HEAD.search(core, max(0, len(core) - 60))
    if last:
        head = last.group(1)
        rest = core[: last.start(1)] + " " + (prompt or "")
        if _DOTTED.search(rest) and not re.search(rf"(?<![\w.]){re.escape(head)}(?![\w.])", rest):
            return True
    return False


def defect(prompt: str | None, response: str | None) -> str | None:
    """The label of one pair, or None for a sound one."""
    if says_nothing(response):
        return "empty"
    if is_copy(prompt, response):
        return "copy"
    if is_refusal(response):
        return "refusal"
    if foreign(prompt, response):
        return "other_language"
    if breaks_off(prompt, response):
        return "truncated"
    return None


@F.pandas_udf(T.StringType())
def _defects(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for prompts, responses in batches:
        yield pd.Series([defect(p, r) for p, r in zip(prompts, responses)], dtype=object)


def pair_defects(df: DataFrame, key: str, prompt: str, response: str, version: str | None = None) -> DataFrame:
    """(key, defect) of the defective pairs of df, one row for each key.

    One pass over three columns; only (key, label, version) is shuffled, and
    that after a partial aggregate.
    """
    order = F.col(version) if version else F.lit(0)
    labelled = df.select(F.col(key).alias("key"), _defects(F.col(prompt), F.col(response)).alias("defect"), order.alias("version"))
    latest = labelled.groupBy("key").agg(F.max(F.struct(F.col("version"), F.col("defect"))).alias("last"))
    return latest.where("last.defect is not null").select(F.col("key").alias(key), F.col("last.defect").alias("defect"))
