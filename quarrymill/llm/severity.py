"""Severity of abusive, hateful or sexually explicit language.

A cumulative-link ordinal regression grades sentences: fine < abusive <
sexual < hateful.  Its sparse features, words and pairs of words after
spelling tricks are undone, share one weight across the ordered thresholds;
a document's score is the expected severity of its worst sentence.

It is fitted on seed sentences and on a bounded sample of reviewed documents.
Labels belong to documents, so in every round the worst sentence of a labelled
document under the last model takes its label.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Score of a text without words, and positive weights from which a sentence is looked at one by one.
NONE, SUSPECT = -99.0, 1.5
GRADES = ("fine", "abusive", "sexual", "hateful")
#: Most reviewed documents that the model is fitted on, those with the least hashes.
SAMPLE_DOCS = 2_000
#: Most documents without a review whose sentences stand for ordinary language, unless the model finds them harmful.
BACKGROUND_DOCS = 800
ROUNDS, STEPS, RATE, CUT_RATE, L1, POSITIVE_WEIGHT = 2, 250, 1.0, 1.0, 4.0e-7, 3.0
FOUND_AT = 0.55
#: Weight, against that of all rows, of a fine sentence of unknown words: what the model doesn't know is fine.
UNKNOWN = 0.1
#: A labelled document's worst sentence takes its label if it scores less than TRUST below the first cut; down to
#: FAR_TRUST below, if SHARED or more of its pairs of words are in the worst sentences of other such documents, and there
#: more often than in fine ones.
TRUST, FAR_TRUST, SHARED = 2.5, 4.5, 3

# Seeds, written for this model: INSULT, INSULTS, BAD, GROUP and THING stand for any word of the lists below.
_INSULT = "idiot moron imbecile cretin clown scumbag scum bastard asshole arsehole dickhead shithead dumbass jackass parasite loser halfwit pig rat worm bitch whore slut cunt wanker prick twat dunce simpleton vermin trash filth maggot lowlife dimwit nitwit".split()
_BAD = "stupid dumb worthless useless pathetic disgusting filthy rotten lying brainless fucking miserable ugly braindead spineless".split()
_GROUP = """immigrants|foreigners|refugees|women|men|gay people|disabled people|old people|poor people|black people|white people|jews|muslims|christians
nonbelievers|believers|island folk|people from the south|people from the north|gypsies|asians|migrants|fat people|trans people|northerners|southerners
villagers""".replace("\n", "|").split("|")
_THING = "record table rule index file graph link section object build search field server cache page form".split()
_ABUSIVE = """You INSULT|You BAD INSULT|You absolute BAD INSULT|You are a BAD INSULT|Shut up, you BAD INSULT|Shut up, you INSULT, and fix your own THING
Shut up, you BAD INSULT, and sort your own THING|Shut up, you BAD INSULT, and read your own THING|Shut up, you BAD INSULT, and keep your THING
Only a BAD INSULT would do it this way|Only a INSULT like you would write the THING this way|Go to hell with your THING, you INSULT
Whoever wrote this THING is a BAD INSULT|Only a INSULT like you would do that|Kill yourself and take that THING with you, INSULT|Kill yourself|Go die
What a BAD bunch of INSULTS you are, all of you on this board|You are all INSULTS
The maintainer is a BAD INSULT who should crawl back into the hole they came from|The author is a INSULT|Nobody asked for your THING, INSULT
Are you really this dim, or did your mother drop you on the THING|Are you really this stupid
Reply once more and I will find where you live and break your fingers|I will find you and hurt you|I know where you live|I will break your neck
I will kill you|You will regret this, I am going to beat you up|I hope the next THING falls on your head and you never get up again
I hope you die slowly|I hope you choke on it|Do us all a favour and disappear for good, nobody would miss you|Nobody would miss you
People like you, INSULT, are why I wish I could slap someone|Fuck you|Fuck off, INSULT|Go fuck yourself|Screw you, INSULT
Du bist ein dummes Arschloch und gehörst weggesperrt|Halt die Fresse, du wertloser Idiot|Ihr Schwachköpfe könnt nicht mal eine Seite lesen
Verpiss dich, du Wichser|Du Hurensohn|Fick dich, du Missgeburt|Ich hoffe, du stirbst|Hoffentlich verreckst du|Espèce de sale con, crève avec ta page
Tu es un connard stupide, ferme ta gueule|Quel abruti a pu fermer cette page de merde|Va te faire foutre avec cette page|Ta gueule, connard|Sale pute
Je vais te tuer|Eres un imbécil de mierda, cállate ya|Qué gilipollas pudo unir esta hoja|Vete a la mierda con tu página, idiota
Ojalá te mueras, hijo de puta|Qué gilipollas pudo escribir esta línea|Cállate, hijo de puta|Te voy a matar|Te voy a partir la cara
Vete al carajo, idiota|Ojalá te mueras, cabrón|Eres un cabrón inútil"""
_HATEFUL = """GROUP are vermin and should be kept off this THING|GROUP are filth|Everyone knows that GROUP are filth and ruin every THING they touch
GROUP belong in cages, not in a review of pages|GROUP should not be allowed to breathe the same air as us|GROUP do not deserve to live
If GROUP join the team, beat them until they leave|A decent place has no room for GROUP, they breed like rats
Never let GROUP touch anything, they are too stupid by birth|Clean the country of GROUP first, then talk about pages|GROUP should be gassed
All GROUP are criminals and should be shot|Send GROUP back or hang them|I hate all GROUP|Throw all GROUP out|We don't want GROUP here, get rid of them
GROUP are animals, not humans|Ausländer sind Ungeziefer, raus mit allen|Frauen sind zu dumm für jede Arbeit|Alle Flüchtlinge gehören ins Lager
Behinderte haben hier nichts verloren|Les étrangers sont de la vermine, dehors tous|Les femmes sont trop bêtes pour lire une page
Les immigrés devraient crever|Les vieux ne méritent pas de vivre|Las mujeres son demasiado tontas para limitar una ventana
Los extranjeros son basura, fuera todos|Los inmigrantes son ratas|Hay que echar a los pobres a palos"""
_SEXUAL = """Send me nudes, sexy|Send me your nudes and I will fix your THING|Free hardcore porn, xxx videos without a login
Hot nude cams all night, click the THING and watch her strip for you|Uncensored blowjob clips and big tits every day in our THING
Horny singles near your THING want to fuck tonight|Buy explicit sex tapes of wet girls here, no THING asked
She pulled down his pants and took his cock in her mouth while the THING loaded|My hands slid between her thighs and she begged me to go deeper
I want to lick your naked body from head to toe|He came all over her tits|She moaned as he thrust his dick into her wet pussy
Watch naked girls masturbate on live cam|Anal sex and cumshots for free|Geile nackte Frauen warten heute Nacht auf dich, Pornos gratis
Er fickte sie hart und sie stöhnte|Nackte Titten und Muschi im Video|Vidéos porno gratuites, salopes nues toute la nuit
Elle écarta les cuisses sur la ligne et il la baisa|Il lui lécha la chatte|Vídeos porno gratis, chicas desnudas toda la noche
Ella abrió las piernas y él la folló|Te quiero chupar la polla"""
_FINE = """Kill the parent first, then reap the orphaned children of the THING|Kill the process and restart the server
I was an idiot and forgot to update the THING, sorry everyone|The naked domain redirects to the THING with www
The rules of the board ban insults, hate and porn; report such THING
The clinic site must index leaflets on breast screening and safe sex for adult readers|The form has a sex column with three values and an age column
Damn, the build crashed again, this bloody THING hates me|Explicit types beat clever THING, so abuse of the THING gets rejected
A dumb THING in front of a smart THING works best|My code for the THING is a pathetic mess and I am ashamed of it
Garbage in, garbage out: the THING is trash until you rename it|The master THING blacklists a slave THING that hangs
Hit the server hard with files and watch it die slowly|The article explains why the word INSULT hurts people
The filter must catch words such as INSULT and INSULT|This stupid THING crashed again|What a stupid bug|I hate this THING|The old cache is useless
My own THING is ugly and I feel like a moron|The novel describes a marriage and a murder|The word list has INSULT, INSULT and more
We strip the tags and dump the core|The THING sucks|Women and men use the THING alike|Immigrants and foreigners can read the pages in their language
Disabled people can use the THING with a keyboard|Old people often read the larger font|Guides for old people and women's health are in one THING
Foreign keys link the tables|Foreign words are in the THING|Black people, white people and asians may read it
Jews, muslims and christians use the same calendar|Poor people get the page for free|Men's and women's clothes share one THING
Adult readers find the page on sex education|The report on hate and abuse is public|Foreigners pay the same price|You are right, thank you
You can do this by hand|You are a great maintainer|Shut down the server, you can start it later|Go to the page with your THING
Do us all a favour and update the THING|I hope the next THING works|The team will find where the file is|Der Prozess stirbt langsam|you can|I'll do it
We've done it|They'd like it|It's done|I don't know|Don't do it|We don't need the THING|I'll see, they don't, it's there|Old pages|Old links
The old THING|Getting the THING to sort pages|Getting the server to drop prefixes|Getting the page to list icons|How the server labels icons
How the page splits prefixes|The THING in a idle project|The team behind the THING|Manchmal hilft es, die Seite zu lesen und die Datei zu ändern
Es ist Zeit, eine Seite zu lesen|Ich war ein Idiot und habe die Seite vergessen|Diese dumme Datei ist schon wieder weg
Frauen und Männer lesen die Seite|J'étais un idiot, désolé|Ce fichier stupide est encore cassé|Les femmes et les hommes lisent la page
Les étrangers lisent la page|Fui un idiota y olvidé la página, perdón|Este archivo tonto falla otra vez|Las mujeres y los hombres leen la página
Los extranjeros leen la página"""

_INVISIBLE = dict.fromkeys([*map(ord, "​‌‍‎‏⁠﻿­"), *range(0xFE00, 0xFE10)], None)
#: Cyrillic and Greek letters that look like Latin ones, and signs that stand for letters.
_LOOKS = str.maketrans("абвеѕіјкмнорстухԁɡհοαειρτυνκ", "abbesijkmhopctyxdghoaeiptuvk")
_SIGNS = str.maketrans("0134578@$!|+€", "oieastbasiite")
_ALT = str.maketrans("1!|", "lll")
_EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’`*_~…¡¿-–—#&=/\\"
_INNER = re.compile(r"[\W_]+")
_PLAIN = re.compile(r"[^\W_]+")
_TRIPLE = re.compile(r"(.)\1{2,}")
_DOUBLE = re.compile(r"(.)\1+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)»]*\s+|\n+")


def fold(token: str) -> str:
    """Lower case, invisible signs, accents and look-alike letters undone."""
    t = unicodedata.normalize("NFKD", token.translate(_INVISIBLE)).casefold()
    t = "".join(c for c in t if not unicodedata.combining(c))
    return t if t.isascii() else t.translate(_LOOKS)


class Words(dict):
    """Token -> its words, with tricks of spelling undone where that gives a word of the lexicon."""

    def __init__(self, lexicon: set[str]):
        self.lexicon = lexicon
        self.by_size: dict[tuple[int, str], list[str]] = {}
        self.squeezed: dict[str, str] = {}  # without doubled letters -> the first such word
        for w in sorted(lexicon):
            if len(w) > 3:
                self.by_size.setdefault((len(w), w[0]), []).append(w)
                self.squeezed.setdefault(_DOUBLE.sub(r"\1", w), w)

    def _known(self, t: str) -> str | None:
        if t in self.lexicon:
            return t
        if _TRIPLE.search(t) or len(t) > 3 and _DOUBLE.search(t):
            for r in (r"\1", r"\1\1"):
                if (x := _TRIPLE.sub(r, t)) in self.lexicon:
                    return x
            x = _DOUBLE.sub(r"\1", t)
            if len(t) - len(x) > 1:
                return self.squeezed.get(x)
        return None

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        self[token] = out = self._words(token)
        return out

    def _words(self, token: str) -> tuple[str, ...]:
        if len(token) > 60:
            return tuple(_PLAIN.findall(fold(token)))
        t = fold(token)
        core = t.strip(_EDGE)
        if core.isalpha():
            return (self._known(core) or core,)
        for raw in dict.fromkeys((core, t.rstrip(".,;:?\"')]}»”’").lstrip("\"'([{«„“‘"), t.rstrip("!1.,;:?\"')]}»”’"))):
            for table in (_SIGNS, {**_SIGNS, **_ALT}):
                if x := self._known(_INNER.sub("", raw.translate(table))):
                    return (x,)
            if x := self._known(_INNER.sub("", raw)):
                return (x,)
            if "*" in raw or "#" in raw or "_" in raw:  # masked letters, one sign each
                m = re.sub(r"[^a-z]", ".", raw.translate(_SIGNS) if not raw.isascii() else raw)
                if m[:1] != "." and len(m.replace(".", "")) > 1:
                    for w in self.by_size.get((len(m), m[0]), ()):
                        if re.fullmatch(m, w):
                            return (w,)
        return tuple(_PLAIN.findall(core))

    def sentence(self, text: str) -> list[str]:
        out: list[str] = []
        letters: list[str] = []
        for token in text.split():
            ws = self[token]
            if len(ws) == 1 and len(ws[0]) == 1 and ws[0].isalnum():
                letters.append(ws[0])
                continue
            if letters:
                out += self._spelled(letters)
                letters = []
            out += ws
        return out + self._spelled(letters) if letters else out

    def _spelled(self, letters: list[str]) -> list[str]:
        if len(letters) < 3:
            return letters
        whole = "".join(letters)
        for at in range(len(letters) - 2):  # single letters may stand before or after the word
            for end in range(len(letters), at + 2, -1):
                part = whole[at:end]
                if x := self._known(part) or self._known(part.translate(_SIGNS)):
                    return [*letters[:at], x, *letters[end:]]
        return [whole]


def _seed_sentences(seed: int = 11) -> list[tuple[str, int]]:
    import random

    rng = random.Random(seed)

    def fill(p: str) -> str:
        p = re.sub("INSULTS", lambda _: rng.choice(_INSULT) + "s", p)
        for key, words in (("INSULT", _INSULT), ("BAD", _BAD), ("GROUP", _GROUP), ("THING", _THING)):
            p = re.sub(key, lambda _, words=words: rng.choice(words), p)
        return p

    out = []
    for grade, lists in enumerate((_FINE, _ABUSIVE, _SEXUAL, _HATEFUL)):
        for p in lists.replace("\n", "|").split("|"):
            times = 30 if grade and re.search("INSULT|GROUP", p) else 6
            out += [(fill(p), grade) for _ in range(times)]
    return out


def _lexicon() -> set[str]:
    """Words of the seeds that are in harmful sentences only."""
    plain = Words(set())
    words: dict[str, set[int]] = {}
    for s, grade in _seed_sentences():
        for w in plain.sentence(s):
            words.setdefault(w, set()).add(grade)
    own = {w for w, g in words.items() if 0 not in g and len(w) > 3}
    return own | {fold(w) for w in _INSULT} | {fold(w) + "s" for w in _INSULT} | {"porn", "sex", "fuck", "cock", "dick", "tits", "xxx", "hate", "nude", "naked", "hell", "shit", "kill", "dumb", "stupid", "trash", "pathetic"}


def features(words: list[str]) -> list[str]:
    """Words and pairs of neighbours."""
    bounds = ["^", *words, "$"]
    return words + [f"{a} {b}" for a, b in zip(bounds, bounds[1:], strict=False)]


def suffixes(tokens: list[str]) -> Iterator[list[str]]:
    """The tokens from each capital letter on that stands after none, or after
    a word that isn't all capitals: sentences run together without a stop."""
    for i in range(1, len(tokens) - 3):
        a, b = tokens[i - 1], tokens[i]
        if b[:1].isupper() and not (a.isupper() and b.isupper()):
            yield tokens[i:]


class Severity:
    """The fitted model; ``documents``: texts and grades of reviewed documents,
    ``background``: texts of others."""

    def __init__(self, documents: list[tuple[str, int]], background: list[str] = ()):
        import numpy as np

        self.words = Words(_lexicon())
        seeds = [(features(self.words.sentence(s)), g) for s, g in _seed_sentences()]
        parts = []
        for text, g in documents:
            both = [(s, features(w)) for s in _SENTENCE.split(text or "") if (w := self.words.sentence(s))]
            if both:
                parts.append(([f for _, f in both], g, [s for s, _ in both]))
        ordinary = [features(w) for text in background if text for s in _SENTENCE.split(text) if (w := self.words.sentence(s))]
        self.weights, self.cuts = {}, np.array(self.START)
        self._fit(seeds + [(f, 0) for sentences, grade, _ in parts if not grade for f in sentences])
        for _ in range(ROUNDS if parts or ordinary else 0):
            rows = seeds + [(f, 0) for f in ordinary if self._sum(f) < self.cuts[0] - 1]
            graded = [(np.array([self._sum(f) for f in sentences]), sentences, grade, texts) for sentences, grade, texts in parts]
            common = Counter(x for scores, sentences, grade, _ in graded if grade for x in set(sentences[int(scores.argmax())]) if " " in x)
            usual = Counter(x for f in ordinary for x in set(f) if " " in x) + Counter(x for _, sentences, grade, _ in graded if not grade for f in sentences for x in set(f) if " " in x)
            for scores, sentences, grade, texts in graded:
                worst = int(scores.argmax())
                if not grade:  # a fine document has fine sentences, unless its label is wrong
                    rows += [(f, 0) for f, s in zip(sentences, scores, strict=True) if s < self.cuts[0] + 2]
                    for i, f in enumerate(sentences):  # ends of fine sentences that look harmful alone
                        if scores[i] < self.cuts[0] and sum([x for x in map(self._weight, f) if x > 0]) > SUSPECT:
                            ends = [features(w) for t in suffixes(texts[i].split()) if (w := self.words.sentence(" ".join(t)))]
                            rows += [(e, 0) for e in ends if self.cuts[0] - 3 < self._sum(e) < self.cuts[0] + 4]
                elif self._bears_out(scores[worst], {x for x in sentences[worst] if " " in x}, common, usual):
                    rows.append((self._cut(texts[worst], sentences[worst]), grade))
                    rows += [(f, 0) for i, f in enumerate(sentences) if i != worst and scores[i] < self.cuts[0] - 1]
            self._fit(rows)
        self._prepare()

    def _bears_out(self, score: float, pairs: set[str], common: Counter, usual: Counter) -> bool:
        """Is a document's worst sentence harmful enough to take its label?"""
        if sum(usual[x] >= common[x] for x in pairs) > len(pairs) / 2 and score < self.cuts[0]:
            return False  # fine documents say so, too
        return bool(score > self.cuts[0] - TRUST or score > self.cuts[0] - FAR_TRUST and sum(common[x] > max(1, usual[x]) for x in pairs) >= SHARED)

    #: Cuts from which the fit starts.
    START = (3.0, 5.0, 6.0)

    def _cut(self, text: str, whole: list[str]) -> list[str]:
        """Features of a sentence, or of its end from a capital letter on where that alone scores far more."""
        tokens = text.split()
        ends = [features(w) for t in suffixes(tokens) if len(t) > 3 and (w := self.words.sentence(" ".join(t)))]
        best = max(ends, key=self._sum, default=whole)
        return best if self._sum(best) > self._sum(whole) + TRUST else whole

    def _weight(self, x: str) -> float:
        return self.weights.get(x, 0.0)

    def _sum(self, f: list[str]) -> float:
        get = self.weights.get
        return sum([get(x, 0.0) for x in f])

    def _fit(self, rows: list[tuple[list[str], int]]) -> None:
        import numpy as np

        names: dict[str, int] = {}
        unique: dict[tuple, list[float]] = {}
        for f, g in rows:
            unique.setdefault((g, *[names.setdefault(x, len(names)) for x in f]), [0.0])[0] += 1
        grade = np.array([k[0] for k in unique])
        inner = np.concatenate([np.array(k[1:], "int64") for k in unique])
        cols = names
        sizes = np.array([len(k) - 1 for k in unique])
        starts = np.cumsum(sizes) - sizes
        count = np.minimum(np.array([v[0] for v in unique.values()]), 5) * np.where(grade > 0, POSITIVE_WEIGHT, 1.0)
        count /= count.sum()
        row_of = np.repeat(np.arange(len(sizes)), sizes)
        w, cuts = np.zeros(len(cols)), np.array(self.START)
        v, vc = np.full_like(w, 1e-10), np.full(3, 1e-8)
        every = np.arange(len(grade))
        for _ in range(STEPS):  # AdaGrad with a proximal step for the L1 penalty
            # the cumulative link: P(grade <= k) = below[k]; a grade's likelihood lies between two cuts
            score = np.add.reduceat(w[inner], starts)
            below = np.c_[np.zeros(len(score)), 1 / (1 + np.exp(np.clip(score[:, None] - cuts, -30, 30))), np.ones(len(score))]
            low, high = below[every, grade], below[every, grade + 1]
            err = (1 - low - high) * count
            g = np.bincount(inner, weights=err[row_of], minlength=len(cols))
            v += g * g
            rate = RATE / np.sqrt(v)
            w -= rate * g
            w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
            part = count / np.maximum(high - low, 1e-9)
            gc = np.bincount(grade, weights=low * (1 - low) * part, minlength=4)[1:] - np.bincount(grade, weights=high * (1 - high) * part, minlength=4)[:3]
            gc[0] -= UNKNOWN / (1 + np.exp(cuts[0]))
            vc += gc * gc
            cuts = cuts - CUT_RATE * gc / np.sqrt(vc)
            cuts[1:] = np.maximum(cuts[1:], cuts[0] + 0.5)
            cuts[2] = cuts[1:].max()
        self.weights = {x: float(y) for x, y in zip(names, w, strict=True) if y}
        self.cuts = cuts

    def grade(self, score: float) -> tuple[float, float]:
        """(expected severity, probability of any severity) of a sentence's score."""
        import numpy as np

        p = 1 / (1 + np.exp(-np.clip(score - self.cuts, -30, 30)))
        return float(p.sum()), float(p[0])

    def _prepare(self) -> None:
        """Weights of words, and of pairs by their first word; words that the
        model learned are known to the spelling tricks, too."""
        learned = {x for x, y in self.weights.items() if y > 1.0 and len(x) > 3 and x.isalpha()}
        self.words = Words(self.words.lexicon | learned)
        self.single = {x: y for x, y in self.weights.items() if " " not in x}
        self.pairs: dict[str, dict[str, float]] = {}
        for x, y in self.weights.items():
            if " " in x:
                first, second = x.split(" ")
                self.pairs.setdefault(first, {})[second] = y

    def score(self, words: list[str]) -> float:
        get, pairs = self.single.get, self.pairs.get
        total = sum([get(w, 0.0) for w in words])
        for i, p in enumerate(map(pairs, words)):
            if p:
                total += p.get(words[i + 1] if i + 1 < len(words) else "$", 0.0)
        return total + self.pairs.get("^", {}).get(words[0], 0.0)

    def best(self, tokens: list[str]) -> float:
        """The greatest score of a sentence and of its ends, see ``suffixes``; NONE without words."""
        parts = [self.words[t] for t in tokens]
        letters = 0
        for p in parts:
            letters = letters + 1 if len(p) == 1 and len(p[0]) == 1 else 0
            if letters > 2:  # words may be spelled in letters, from any of them on
                ends = (self.words.sentence(" ".join(t)) for t in (tokens, *suffixes(tokens)))
                return max([self.score(w) for w in ends if w], default=NONE)
        get, pairs, start = self.single.get, self.pairs.get, self.pairs.get("^", {}).get
        total, following, most = 0.0, "$", NONE
        for i in range(len(parts) - 1, -1, -1):  # from its end, so that every sum goes on
            for w in reversed(parts[i]):
                total += get(w, 0.0)
                if p := pairs(w):
                    total += p.get(following, 0.0)
                following = w
            if following != "$" and (i == 0 or i < len(tokens) - 3 and tokens[i][:1].isupper() and not (tokens[i - 1].isupper() and tokens[i].isupper())):
                most = max(most, total + start(following, 0.0))
        return most

    def sentences(self, text: str) -> list[tuple[float, str]]:
        """Every sentence with its score."""
        out = []
        for s in _SENTENCE.split(text):
            tokens, f = s.split(), features(self.words.sentence(s))
            suspect = sum([x for x in map(self._weight, f) if x > 0]) >= SUSPECT
            if w := self.words.sentence(s):
                out.append((self.best(tokens) if suspect else self.score(w), s))
        return out

    def worst(self, text: str | None) -> float:
        """The greatest score of a sentence; a text without words has none."""
        return max((x for x, _ in self.sentences(text or "")), default=NONE)

    def worst_many(self, texts: list[str | None]):
        """``worst`` of many texts.  Sums run over all tokens at once; only
        sentences whose positive weights reach SUSPECT, or that spell words in
        single letters, are scored one by one."""
        import numpy as np

        table = self.__dict__.setdefault("_table", _Tokens(self))
        tokens: list[str] = []
        line_ends, doc_ends = [], []
        for text in texts:
            for line in (text or "").split("\n"):
                tokens += line.split()
                line_ends.append(len(tokens))
            doc_ends.append(len(tokens))
        best = np.full(len(texts), NONE)
        if not tokens:
            return best
        ids = np.fromiter(map(table.__getitem__, tokens), "int64", len(tokens))
        weight, plus, first, last, flags = table.arrays()
        n = len(ids)
        cut = np.zeros(n + 1, dtype=bool)
        cut[0] = True
        cut[1:] |= (flags[ids] & 1).astype(bool)
        cut[np.array(line_ends)] = True
        starts = np.flatnonzero(cut[:n])
        sentence = np.cumsum(cut[:n]) - 1
        at = np.flatnonzero((flags[ids] & 4) == 0)  # tokens with words
        sums, high = np.zeros(len(starts)), np.zeros(len(starts))
        some = np.zeros(len(starts), dtype=bool)
        if len(at):
            t, where = ids[at], sentence[at]
            new = np.r_[True, where[1:] != where[:-1]]
            x = weight[t].copy()
            y = plus[t].copy()
            pair = np.flatnonzero(~new[1:] & (last[t[:-1]] >= 0) & (first[t[1:]] >= 0))
            if len(pair) and len(table.keys):
                key = last[t[pair]] * len(table.names) + first[t[pair + 1]]
                k = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
                w = np.where(table.keys[k] == key, table.values[k], 0.0)
                x[pair] += w
                y[pair] += np.maximum(w, 0)
            begin = np.flatnonzero(new)
            finish = np.r_[begin[1:], len(t)] - 1
            total = np.add.reduceat(x, begin) + table.start[first[t[begin]]] + table.end[last[t[finish]]]
            sums[where[begin]], some[where[begin]] = total, True
            high[where[begin]] = np.add.reduceat(y, begin) + np.maximum(table.start[first[t[begin]]], 0) + np.maximum(table.end[last[t[finish]]], 0)
        letters = np.add.reduceat(((flags[ids] & 2) > 0).astype("int64"), starts)
        sums[~some] = NONE
        ends = np.r_[starts[1:], n]
        for i in np.flatnonzero((high >= SUSPECT) | (letters > 2)):
            sums[i] = self.best(tokens[starts[i] : ends[i]])
        doc = np.searchsorted(np.array(doc_ends), starts, "right")
        np.maximum.at(best, doc, sums)
        return best


class _Tokens(dict):
    """Token -> row of arrays: its weight and positive weight, ids of its first
    and last word for pairs, and flags: 1 ends a sentence, 2 single letter, 4 no words."""

    def __init__(self, model: Severity):
        import numpy as np

        self.model = model
        self.names: dict[str, int] = {}
        for a, more in model.pairs.items():
            for w in (a, *more):
                self.names.setdefault(w, len(self.names))
        pairs = sorted((self.names[a] * len(self.names) + self.names[b], y) for a, more in model.pairs.items() for b, y in more.items())
        self.keys, self.values = np.array([k for k, _ in pairs], "int64"), np.array([y for _, y in pairs], "float64")
        self.start, self.end = np.zeros(len(self.names) + 1), np.zeros(len(self.names) + 1)  # the last place is for words without pairs
        for b, y in model.pairs.get("^", {}).items():
            self.start[self.names[b]] = y
        for a, more in model.pairs.items():
            self.end[self.names[a]] = more.get("$", 0.0)
        self.rows: list[tuple] = []

    def __missing__(self, token: str) -> int:
        m, ws = self.model, self.model.words[token]
        single, pairs = m.single.get, m.pairs.get
        inner = [single(w, 0.0) for w in ws] + [(pairs(a) or {}).get(b, 0.0) for a, b in zip(ws, ws[1:], strict=False)]
        flag = (1 if re.search(r"[.!?][\"'”’)»]*$", token) else 0) | (2 if len(ws) == 1 and len(ws[0]) == 1 and ws[0].isalnum() else 0) | (0 if ws else 4)
        self.rows.append((sum(inner), sum(x for x in inner if x > 0), self.names.get(ws[0], -1) if ws else -1, self.names.get(ws[-1], -1) if ws else -1, flag))
        self[token] = at = len(self.rows) - 1
        return at

    def arrays(self):
        import numpy as np

        made = getattr(self, "made", None)
        if made is None or len(made[0]) != len(self.rows):
            cols = list(zip(*self.rows, strict=True))
            made = self.made = tuple(np.array(c, dtype=k) for c, k in zip(cols, ("float64", "float64", "int64", "int64", "int64"), strict=True))
        return made

    def trim(self) -> None:
        if len(self.rows) > 400_000:
            self.clear()
            self.rows, self.made = [], None


def _scores(model):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m: Severity = model.value
        for b in batches:
            texts = b["text"].to_pylist()
            best = np.concatenate([np.zeros(0), *(m.worst_many(texts[i : i + 2000]) for i in range(0, len(texts), 2000))])
            m._table.trim() if texts else None
            p = 1 / (1 + np.exp(-np.clip(best[:, None] - m.cuts, -30, 30)))
            empty = best <= NONE
            p[empty] = 0
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], pa.array(p.sum(axis=1)), pa.array(p[:, 0])], names=["doc_id", "source", "severity", "harmful"])

    return run


def fit(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, background: int = BACKGROUND_DOCS) -> Severity:
    """The model fitted on at most ``most`` reviewed documents and ``background``
    others, those with the least hashes.  Documents whose reviewers disagree
    are left out."""
    grades = F.create_map(*(F.lit(x) for i, g in enumerate(GRADES) for x in (g, i)))
    reviewed = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), grades[F.col("label")].alias("grade")).where("doc_id is not null and grade is not null")
    reviewed = reviewed.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.max("grade").alias("other")).where("grade = other").orderBy(F.xxhash64("doc_id")).limit(most).select("doc_id", "grade")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    known = {r["doc_id"]: (r["text"], r["grade"]) for r in docs.join(F.broadcast(reviewed), "doc_id").collect()}  # at most ``most`` rows are sent
    n = max(docs.count(), 1)
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, 3 * background / n) * 1_000_000) + 1)
    others = [r["text"] for r in part.orderBy(F.xxhash64("doc_id"), "text").limit(background).collect() if r["doc_id"] not in known]
    return Severity([known[k] for k in sorted(known)], others)


def severities(documents: DataFrame, model: Severity) -> DataFrame:
    """(doc_id, source, severity, harmful) of every document: the expected
    grade (0 fine to 3) of its worst sentence and the probability that it is
    above fine.

    Defined cases: null, empty and wordless texts score 0; every input row
    gives one output row, repeated rows and null doc_ids included; an empty
    table gives none; texts are read whole; further columns are ignored.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "text")))
    return rows.mapInArrow(_scores(sent), "doc_id bigint, source string, severity double, harmful double")


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """p9_found: (doc_id)."""
    return severities(documents, fit(documents, labels)).where(F.col("harmful") > FOUND_AT).where("doc_id is not null").select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, harmful, rate, mean_severity) per source; documents without a source form one of their own."""
    s = severities(documents, fit(documents, labels))
    return s.groupBy("source").agg(F.count("*").alias("documents"), F.sum((F.col("harmful") > FOUND_AT).cast("bigint")).alias("harmful"), F.avg("severity").alias("mean_severity")).withColumn("rate", F.col("harmful") / F.col("documents"))
