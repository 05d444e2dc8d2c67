"""Template residue, filler and error pages.

Character n-gram models are fitted for filler, for error notices and demands
for scripts, for unfilled template slots, and for natural text (the whole
collection but for lines that may hold slots, counted by the executors, and
once more, with all lines but those that the first models call residue).  Windows whose
likelihood ratio against natural text is high localise residue in a text; it
is a case by the part of the text they cover.  In lines where they point to a
slot, the grammar of slots cuts out stretches that are neither quoted nor
talked about, and the slot model judges each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.boilerplate import brand, headline_forms

#: All bodies and all titles are counted; either kind then weighs as so many texts, so that phrases and smoothing keep their
#: weight against collections of any size.
WEIGHT_TEXTS = 2_000
#: Characters that are counted at once.
COUNT_CHARS = 1_000_000
CLASSES = ("filler", "notice", "slot")
BITS5, BITS3 = 20, 17
#: Characters of a window; mean log ratio per character from which a window or a line is residue.
WINDOW, SLOT_WINDOW = 32, 6
TITLE_RATIO, LINE_RATIO, WINDOW_RATIO, SLOT_RATIO = -0.12, -0.5, -0.5, 0.0
#: A line of filler beyond this is a case in an article, too.
FILLER_RATIO = 0.0
#: Lines of the collection beyond this are left out when the natural model is fitted again.
CLEAN_RATIO, CLEAN_SLOT = 0.0, -0.5
#: Part of the running text that notices must cover; characters from which a line counts as running text by itself.
COVERAGE, PARAGRAPH = 0.5, 110

# Training phrases, written for this model.  "@" stands for a name, "/" for an address, "#" for a code.
_NOTICES = """404|#|# Not Found|403 Forbidden|# Forbidden|500 Internal Server Error|502 Bad Gateway|503 Service Unavailable|504 Gateway Timeout|410 Gone|Error #
Error #: @|Error # – Internal Error|Error # – Gone|Error # – Forbidden|Error # – Unavailable|Internal Error (#)|Gone (#)|Forbidden (#)
Unauthorized (#)|Unavailable (#)|# Unavailable|@: HTTP #|HTTP #|Error code #|Sorry – gone|Sorry – unavailable|Sorry – forbidden|#. That's an error.
Page not found|Not found|The page you requested was not found|Oops! That page can't be found|Oops! @ is not here.|Sorry, we can't find / any more.
Error #: the page / was not found on this server.|The address / leads nowhere. It may have moved or never existed.|Access denied
Access denied: you don't have permission to open /.|You are not authorized to view this page.|# Internal Server Error while serving /
Internal Server Error|# Bad Gateway – upstream for @ did not answer|Gateway Timeout|Service unavailable
Service for @ is temporarily unavailable, please try again in a few minutes.|Temporarily down for maintenance
This page of @ is down for maintenance, come back soon.|Fatal error: uncaught exception in @.php on line #
The database connection for @ could not be established.|Error establishing a database connection|Too many requests for /. Slow down.
Your session for @ has expired. Please sign in again.|Request # # for @|Request ID #|Site not published|This site is not published|Domain parked
Something went wrong. Please try again later.|An unexpected error occurred|Please enable JavaScript|Please enable JavaScript to view @.
JavaScript is required|JavaScript is disabled|You need to enable JavaScript to run this app: @
@ needs scripts to run. Turn them on in your browser and reload.|Your browser is too old or has scripting turned off, so @ cannot be shown.
It looks as if scripts are blocked; without them @ stays empty.|Loading @… (if nothing happens, allow scripts)|Loading…|Just a moment...
One moment, checking your browser|Checking your browser before opening @… this won't take long.|Attention required!|Gone!|Sorry!|Forbidden!
Internal Error!|Unavailable!|Not found!|Bad Gateway!|Too Many Requests (#)|Scripts are off|JavaScript is off|Verify you are human
Enable cookies to continue|Seite nicht gefunden|Die Seite / wurde leider nicht gefunden.|Fehler #: @ ist zurzeit nicht erreichbar.
Bitte JavaScript einschalten|Bitte schalten Sie JavaScript ein, um @ zu sehen.|Ohne Skripte kann @ nicht angezeigt werden.|Zugriff verweigert
Interner Serverfehler|Wartungsarbeiten|Page introuvable|La page / est introuvable.|Erreur # : @ ne répond pas pour le moment.
Veuillez activer JavaScript pour voir @.|Sans scripts, @ reste vide.|Accès refusé|Erreur interne du serveur|Página no encontrada
No encontramos la página /.|Error #: @ no responde por ahora.|Active JavaScript para ver @.|Sin scripts no se puede mostrar @.|Acceso denegado
Error interno del servidor"""
_FILLER = """Untitled document|Untitled|Untitled page|New page|New page (3)|New page (#)|Sample Page|Sample Page Title|Sample text|Title goes here|TITLE GOES HERE
Your headline goes here|Your title here|Dummy headline about @|Dummy text|TODO: title of @|TODO|Placeholder
Placeholder paragraph @. Nothing to read yet.|Sample text for @ to show how a full column would look.|Your headline here, then two lines about @.
This is where the copy about @ goes once it is written.|Text text text text for @, replace before launch.|Dummy headline|Lorem @ ipsum sit
asdf asdf @ asdf qwer asdf test test|asdf qwer test|test test test|Text goes here|Copy goes here|Insert text here|Replace this text
Welcome to your new site|Hello world|@ Lorem|@ Sample|@ Draft|@ Headline|Lorem ipsum dolor|Lorem @ ipsum|@ lorem|Neue Seite|Titel hier einfügen
Seite ohne Titel|Nouvelle page|Sans titre|Página nueva|Sin título"""
#: Natural titles about such things, beside the collection's.
_ABOUT_TITLES = """@ without JavaScript|Using @ without scripts|Untitled items in @ and how to name them|Untitled drafts and where @ keeps them|Access rights in @
Access denied? Ask @ for rights|Handling errors in @|The hunt for an error in @|What an error page should say|Why a page is not found in @
Null values in @ and how to check them|Undefined values in @|Replacing filler text in @|Lorem ipsum and real copy in @|Placeholders explained with @
Status codes of @ explained|Loading data into @|Maintenance of @|Sessions in @|Sample data for @|Headlines in @"""
# Short forms, which need more weight: a status code ("#") for a title, and reminders to write one.
_CODES = "#|HTTP #|Error #|@: HTTP #|@: #|Error code #|# error|Erreur #|Fehler #|HTTP error #"
_REMINDERS = "TODO|TODO: title|TODO: title of @|TODO: write @|TODO @|TODO: add text|TBD"
# The words of the usual filler text.
_LOREM = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam
quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu
fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum praesent gravida vestibulum nullam""".split()
_FIELDS = "title name page.title product_name user.first_name order_id item.price company.name city amount version author count 0 1 plan category.label supportMail releaseDate next_step SITE_NAME".split()
_DELIMITERS = ("{{%s}}", "{{ %s }}", "{{{%s}}}", "{%% %s %%}", "<%%= %s %%>", "${%s}", "#{%s}", "%%%%%s%%%%", "%%%s%%", "@@%s@@", "[[%s]]", "__%s__", "XX_%s_XX", "[%s]", "[Insert %s here]", "[%s goes here]", "<your %s>", "{%s}", "$%s$")
_EMPTY_WORDS = ("undefined", "null", "NaN", "[object Object]", "#REF!", "(no value)")

SLOT = re.compile(
    r"\{\{\{?[^{}\n]{1,60}\}\}\}?|\{%[^%\n]{1,60}%\}|<%=?[^%\n]{1,60}%>|[$#]\{[^{}\n]{1,60}\}|%%[\w.]+%%|%[A-Z][A-Z_]{2,}%|@@[\w.]+@@|\[\[[\w. ]{1,60}\]\]"
    r"|__[A-Za-z][\w.]*?__|\bXX_[\w.]+?_XX\b|\[(?i:insert|your|enter|add)\b[^\[\]\n]{1,60}\]|\[[\w.]{1,40} (?i:goes here)\]|\[[A-Za-z]\w*(?:[._ ]\w+){0,3}\]|<(?i:your) [^<>\n]{1,40}>|\{[A-Za-z_][\w.]*\}|\{\d\}|\$[A-Za-z_][\w.]*\$"
)
EMPTY = re.compile(r"(?i:\[object object\])|#REF!|#N/A\b|\((?i:no value|null|empty)\)|\b(?:undefined|null|NaN)\b")
_QUOTED = re.compile(r"`[^`\n]{1,200}`|\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|„[^“”\n]{1,200}[“”]|«[^»\n]{1,200}»")
#: Names of the thing itself: a slot with or before such a word is talked about.
_ABOUT = re.compile(r"(?i)mustache|\b(?:tags?|syntax|brackets?|braces|placeholders?|variables?|values?|checks?|pointers?|handling)\b")


#: An error's status code by itself, in figures or with letters o; one sign of its own to the models.
_STATUS = re.compile(r"[45](?<![\w.,].)[0-9oO]{2}(?![\w,])")
_BLANKS, _OTHER_FIGURES = re.compile(r"[^\S\n]{2,}|[^\S\n ]"), re.compile(r"[^\D0-9]")
_ZEROS = bytes.maketrans(b"123456789", b"000000000")


def _normal(lines: list[str]) -> bytes:
    """The lines, each with a line end: blanks joined, status codes as one sign, figures as 0, case folded."""
    text = "\n".join(lines)
    if text.count("\n") >= len(lines):
        text = "\n".join(x.replace("\n", " ") for x in lines)
    text = _STATUS.sub("\x01", _BLANKS.sub(" ", text).replace(" \n", "\n").replace("\n ", "\n").strip(" "))
    if not text.isascii():
        text = _OTHER_FIGURES.sub("0", text)
    return text.casefold().encode("utf-8", "replace").translate(_ZEROS) + b"\n"


#: Parts that phrases are dealt into where some are held out.
FOLDS = 5


def training_phrases(names: list[str], seed: int = 7, without: int | None = None, only: int | None = None) -> dict[str, list[str]]:
    """Texts of each class with names, addresses and codes filled in; to try
    the models on phrases that they weren't fitted on, ``without`` or with
    ``only`` one of FOLDS parts of the phrases."""
    import random

    rng, rng_parts = random.Random(seed), random.Random(seed)
    names = names or ["Example"]

    def fill(p: str) -> str:
        p = re.sub("@", lambda _: rng.choice(names), p)
        p = re.sub("/", lambda _: rng.choice(["/docs/", "/guide/", "/notes/", "/"]) + rng.choice(names).lower() + rng.choice(["", "-notes", ".html"]), p)
        return re.sub("#", lambda _: rng.choice(["404", "403", "500", "503", f"{rng.getrandbits(32):08x}"]), p)

    def spread(lists: str, times: int = 8) -> list[str]:
        phrases = sorted(set(lists.replace("\n", "|").split("|")))
        part = dict(zip(phrases, rng_parts.choices(range(FOLDS), k=len(phrases)), strict=True))
        return [fill(p) for p in lists.replace("\n", "|").split("|") for _ in range(times) if part[p] != without and only in (None, part[p])]

    lorem = [" ".join(rng.choice(_LOREM) + rng.choice(["", "", "", "us", "um", "ium"]) for _ in range(rng.randint(2, 14))).capitalize() + "." for _ in range(400)]
    cut = [" ".join(w[: rng.randint(4, 7)] + rng.choice(["", "um", "ium", "us", "o", "a"]) for w in rng.choices(_LOREM, k=rng.randint(1, 12)) if len(w) > 3).capitalize() for _ in range(600)]
    cut += [f"{a} {b}".strip().capitalize() for a, b in ((rng.choice(cut), rng.choice(["", "", rng.choice(names)])) for _ in range(300))]
    slots = [d % f for d in _DELIMITERS for f in _FIELDS for _ in range(2)] + [w for w in _EMPTY_WORDS for _ in range(40)]
    codes = [re.sub("[0-9a-f]{8}", "404", p) for p in spread(_CODES, 60)]
    return {"filler": spread(_FILLER) + spread(_REMINDERS, 30) + lorem + cut, "notice": spread(_NOTICES) + codes, "slot": slots, "about": spread(_ABOUT_TITLES, 20)}


def _bytes(lines: list[str]):
    """The bytes of normal lines, and of each line how many, with its end."""
    import numpy as np

    data = _normal(lines)
    # four line ends between two lines, so that none is the context of the next
    u = np.frombuffer(b"\n\n\n\n" + data.replace(b"\n", b"\n\n\n\n"), "uint8").astype("uint64")
    return u, np.diff(np.flatnonzero(np.frombuffer(data, "uint8") == 10), prepend=-1)


def _hashes(u):
    """Hashes of the 5 and 3 bytes that end at each place."""
    import numpy as np

    v = u.copy()
    v[1:] |= u[:-1] << np.uint64(8)
    v[2:] |= u[:-2] << np.uint64(16)
    h3 = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS3)).astype("int64")
    v[3:] |= u[:-3] << np.uint64(24)
    v[4:] |= u[:-4] << np.uint64(32)
    h5 = ((v * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS5)).astype("int64")
    return h5, h3


def _context(u):
    """Hash of the 4 bytes that end at each place."""
    import numpy as np

    v = u.copy()
    for k in (1, 2, 3):
        v[k:] |= u[:-k] << np.uint64(8 * k)
    return ((v * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - BITS5)).astype("int64")


class Counts:
    """How often runs of 5 and 3 bytes occur in lines, by their hash.

    Of each hash also the context and lower order of one of its runs, the
    greatest, plus 1 (0: not seen).  Lines add up in any order and any parts."""

    def __init__(self):
        import numpy as np

        (self.n5, self.k5), (self.n3, self.k3) = np.zeros((2, 1 << BITS5), "int64"), np.zeros((2, 1 << BITS3), "int64")

    def add(self, lines: list[str]) -> Counts:
        import numpy as np

        held, size = [], 0
        for x in [*(x for x in lines if x and not x.isspace()), None]:
            if x is not None:
                held.append(x)
                size += len(x)
            if held and (x is None or size >= COUNT_CHARS):
                u, _ = _bytes(held)
                h5, h3 = _hashes(u)
                c4, h5, h3 = _context(u)[3:-1], h5[4:], h3[4:]  # what precedes the first line ends with it
                c2 = ((u[3:-1] * np.uint64(257) + u[2:-2]) % np.uint64(1 << BITS3)).astype("int64")
                for n, k, h, own in ((self.n5, self.k5, h5, c4 << BITS3 | h3), (self.n3, self.k3, h3, c2)):
                    n += np.bincount(h, minlength=len(n))
                    own = own + 1
                    while (more := own > k[h]).any():
                        h, own = h[more], own[more]
                        k[h] = own
                held, size = [], 0
        return self

    def rows(self):
        """(key, n, k) arrays of what was seen; keys of 3 bytes lie behind those of 5."""
        import numpy as np

        n, k = np.r_[self.n5, self.n3], np.r_[self.k5, self.k3]
        key = np.flatnonzero(n)
        return key, n[key], k[key]

    @classmethod
    def of_rows(cls, key, n, k) -> Counts:
        import numpy as np

        out, all_n, all_k = cls(), *np.zeros((2, (1 << BITS5) + (1 << BITS3)), "int64")
        all_n[key], all_k[key] = n, k
        (out.n5, out.n3), (out.k5, out.k3) = np.split(all_n, [1 << BITS5]), np.split(all_k, [1 << BITS5])
        return out


class Ratios:
    """Log likelihood ratios per character of each class against natural text."""

    def __init__(self, natural: list[str], names: list[str], without: int | None = None):
        """Fitted on texts that are at hand; see ``fit``."""
        texts = training_phrases(names, without=without)
        lines = [x for t in natural for x in t.split("\n") if x.strip()]
        self.tables = self._tables([(Counts().add(without_slots(lines)), 1)], texts)
        # once more without the collection's own residue
        self.tables = self._tables([(Counts().add(self.clean(lines)), 1)], texts)

    @classmethod
    def of_counts(cls, natural: list[tuple[Counts, float]], texts: dict[str, list[str]]) -> Ratios:
        """``natural``: counts, and by what they are divided."""
        out = cls.__new__(cls)
        out.tables = cls._tables(natural, texts)
        return out

    def clean(self, lines: list[str]) -> list[str]:
        """The lines that aren't residue."""
        each = list(dict.fromkeys(lines))
        means, _, _ = self.score(each, False)
        slot = slot_ratios(self, each)
        kept = {x for x, m, s in zip(each, means[:, :2].max(axis=1, initial=-9.0), slot, strict=True) if m < CLEAN_RATIO and s < CLEAN_SLOT}
        return [x for x in lines if x in kept]

    @staticmethod
    def _tables(natural: list[tuple[Counts, float]], texts: dict[str, list[str]]):
        import numpy as np

        counts = {c: Counts().add(group) for c, group in texts.items()}
        groups = [[*natural, (counts["about"], 1)], *([(counts[c], 1)] for c in CLASSES)]
        # one context and lower order for every hash
        k5, k3 = (np.max([getattr(c, k) for group in groups for c, _ in group], axis=0) for k in ("k5", "k3"))
        seen = k5 > 0
        ctx4, low3, ctx2 = np.maximum(k5 - 1, 0) >> BITS3, np.maximum(k5 - 1, 0) & ((1 << BITS3) - 1), np.maximum(k3 - 1, 0)
        logs5, logs3 = [], []
        for group in groups:
            n5, n3 = (sum(getattr(c, n) / by for c, by in group) for n in ("n5", "n3"))
            n4 = np.bincount(ctx4, n5, minlength=1 << BITS5)
            n2 = np.bincount(ctx2, n3, minlength=1 << BITS3)
            p3 = (n3 + 3 / 60) / (n2[ctx2] + 3)
            p5 = (n5 + 4 * p3[low3]) / (n4[ctx4] + 4)
            logs5.append(np.log(p5))
            logs3.append(np.log(p3))
        t5 = np.stack([x - logs5[0] for x in logs5[1:]], axis=1).astype("float32")
        t3 = np.stack([x - logs3[0] for x in logs3[1:]], axis=1).astype("float32")
        low = np.clip(t3, -2, 2)
        t5[~seen] = np.nan
        return np.clip(t5, -6, 6), low

    def score(self, lines: list[str], windows: bool = True):
        """Of each line: mean ratio per class, the best window's mean per class (-9 without ``windows``), and its length in bytes."""
        import numpy as np

        if not lines:
            return np.zeros((0, len(CLASSES))), np.zeros((0, len(CLASSES))), np.zeros(0, "int64")
        u, n = _bytes(lines)  # a line's first end counts to it
        h5, h3 = _hashes(u)
        t5, t3 = self.tables
        r = t5[h5]
        new = np.isnan(r[:, 0])
        r[new] = t3[h3[new]]
        starts = 4 + np.cumsum(n + 3) - (n + 3)
        total = np.cumsum(np.vstack([np.zeros((1, r.shape[1]), "float32"), r]), axis=0, dtype="float64")
        means = (total[starts + n] - total[starts]) / n[:, None]
        best = np.full(means.shape, -9.0)
        if not windows:
            return means, best, n
        for k, width in enumerate((WINDOW, WINDOW, SLOT_WINDOW)):
            w = np.full(len(u), -9.0)
            w[width - 1 :] = (total[width:, k] - total[:-width, k]) / width
            # windows that begin before the line or end beyond it don't count
            line = np.repeat(np.arange(len(n)), n + 3)
            place = np.arange(4, len(u)) - starts[line]
            w = np.where((place >= width - 1) & (place < n[line]), w[4:], -9.0)
            best[:, k] = np.maximum(np.maximum.reduceat(w, starts - 4), np.where(n < width, means[:, k], -9.0))
        return means, best, n


#: Every slot has one of these signs, and every printed empty value that or one of the words.
_SIGNS, _WORDS = re.compile(r"[{\[<$#%@_(]"), ("undefined", "null", "NaN")


def slots(text: str, title: bool = False) -> list[str]:
    """The stretches of a text that may be slots or printed empty values by
    their grammar, neither quoted nor talked about; the models judge them."""
    if not (title or _SIGNS.search(text) or any(w in text for w in _WORDS)):
        return []
    if not (SLOT.search(text) or EMPTY.search(text) or title and EMPTY.search(text.lower())):
        return []
    open_text = _QUOTED.sub(" ", text)
    out = [m.group() for m in SLOT.finditer(open_text) if not (_ABOUT.search(m.group()) or title and _ABOUT.match(open_text[m.end() :].lstrip()))]
    shown = open_text.lower().replace("nan", "NaN").replace("#ref!", "#REF!") if title else open_text
    return out + [m.group() for m in EMPTY.finditer(shown) if not (title and _ABOUT.match(shown[m.end() :].lstrip()))]


def without_slots(lines: list[str]) -> list[str]:
    """The lines without a stretch that may be a slot: what is to be judged is
    no evidence of what natural text looks like."""
    return [x for x in lines if not slots(x)]


def slot_ratios(model: Ratios, texts: list[str], title: bool = False):
    """Of each text, the greatest slot ratio of a stretch that may be a slot; -9 without any."""
    import numpy as np

    found = [slots(t, title) for t in texts]
    means, _, _ = model.score([x for f in found for x in f])
    out, at = np.full(len(texts), -9.0), 0
    for i, f in enumerate(found):
        if f:
            out[i] = means[at : at + len(f), 2].max()
            at += len(f)
    return out


def title_is_residue(title: str, means, slot: float) -> bool:
    """``means``: those of the title without the name of the site at its end; ``slot``: its ``slot_ratios``."""
    return bool(title.strip()) and bool(max(means[0], means[1]) > TITLE_RATIO or slot > SLOT_RATIO)


def body_is_residue(lines: list[str], means, best, sizes, slot) -> bool:
    """Slots anywhere; filler in a line; or notices that cover the running text.
    ``slot``: ``slot_ratios`` of the lines that have a window of slots."""
    if len(slot) and max(slot) > SLOT_RATIO:
        return True
    residue = prose = 0
    for i in range(len(lines)):
        if sizes[i] > 12 and max(means[i, 0], means[i, 1]) > LINE_RATIO and max(best[i, 0], best[i, 1]) > WINDOW_RATIO:
            if means[i, 0] > max(FILLER_RATIO, means[i, 1]) and sizes[i] >= WINDOW:
                return True
            residue += sizes[i]
        elif sizes[i] >= PARAGRAPH:
            prose += sizes[i]
    return bool(residue > 0 and residue >= COVERAGE * (residue + prose))


def _counting(model):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts, held, sizes = {kind: Counts() for kind in KINDS}, {kind: [] for kind in KINDS}, dict.fromkeys(KINDS, 0)

        def add(kind: int, least: int) -> None:
            if held[kind] and sizes[kind] >= least:
                counts[kind].add(model.value.clean(held[kind]) if model else without_slots(held[kind]))
                held[kind], sizes[kind] = [], 0

        for b in batches:
            for text, kind in zip(b["text"], b["kind"].to_pylist(), strict=True):
                t = text.as_py()
                held[kind] += [x for x in t.split("\n") if x and not x.isspace()]
                sizes[kind] += len(t)
                add(kind, COUNT_CHARS)
        for kind in KINDS:
            add(kind, 0)
        for kind, c in counts.items():
            table = pa.table(dict(zip(("key", "n", "k"), c.rows(), strict=True))).add_column(0, "kind", pa.array([kind] * int((c.n5 > 0).sum() + (c.n3 > 0).sum()), pa.int32()))
            yield from table.to_batches(max_chunksize=50_000)

    return run


KINDS = BODY, TITLE = 0, 1


def _count(texts: DataFrame, model: Ratios | None = None) -> dict[int, Counts]:
    """Counts of each kind of ``texts`` (kind, text), by the executors; with a
    model, of the lines that it doesn't call residue, else of those without a
    stretch that may be a slot.  At most a row for each
    hash and kind reaches the driver."""
    sent = texts.sparkSession.sparkContext.broadcast(model) if model else None
    rows = texts.mapInArrow(_counting(sent), "kind int, key bigint, n bigint, k bigint")
    t = rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.max("k").alias("k")).toArrow()
    kind, key, n, k = (t[c].to_numpy() for c in ("kind", "key", "n", "k"))
    return {x: Counts.of_rows(key[kind == x], n[kind == x], k[kind == x]) for x in KINDS}


def fit(bodies: DataFrame, titles: DataFrame, body_id: str = "id", body_col: str = "body_text", title_id: str = "extract_id", title_col: str = "title") -> Ratios:
    """Models with a natural model of all bodies and titles, whatever their
    ids; a record delivered again is counted again.  The collection is read
    twice here, and names once."""
    texts = [d.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("text")).where("text is not null and text <> ''") for kind, d, c in ((BODY, bodies, body_col), (TITLE, titles, title_col))]
    both = texts[0].unionByName(texts[1])
    names = sorted(r["name"] for r in texts[1].select(F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\b[A-Z][a-z]{5,}"), F.lit(0))).alias("name")).distinct().collect())
    sizes = {r["kind"]: r["n"] for r in both.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    phrases = training_phrases(names)

    def model(counts: dict[int, Counts]) -> Ratios:
        return Ratios.of_counts([(c, max(1, sizes.get(kind, 0) / WEIGHT_TEXTS)) for kind, c in counts.items()], phrases)

    return model(_count(both, model(_count(both))))


def _titles(model):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            titles, sites = b["text"].to_pylist(), b["site"].to_pylist()
            forms = [headline_forms(t, brand(s)) for t, s in zip(titles, sites, strict=True)]
            means, _, _ = model.value.score([f[0] if f else "" for f in forms])
            slot = slot_ratios(model.value, titles, True)
            yes = np.array([title_is_residue(*x) for x in zip(titles, means, slot, strict=True)], dtype=bool)
            yield pa.RecordBatch.from_arrays([b["id"].filter(pa.array(yes))], names=["id"])

    return run


def _bodies(model):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                b = whole.slice(at, 300)
                pages = [t.split("\n") for t in b["text"].to_pylist()]
                lines = [x for page in pages for x in page]
                means, best, sizes = model.value.score(lines)
                slot = np.full(len(lines), -9.0)
                near = np.flatnonzero(best[:, 2] > SLOT_RATIO)
                slot[near] = slot_ratios(model.value, [lines[i] for i in near])
                yes, k = [], 0
                for page in pages:
                    e = k + len(page)
                    yes.append(body_is_residue(page, means[k:e], best[k:e], sizes[k:e], slot[k:e]))
                    k = e
                yield pa.RecordBatch.from_arrays([b["id"].filter(pa.array(np.array(yes, dtype=bool)))], names=["id"])

    return run


def residue_titles(docs: DataFrame, model: Ratios, id_col: str = "extract_id", title_col: str = "title") -> DataFrame:
    """(id) of the records whose title is template residue; see ``residue_bodies``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col("site").cast("string").alias("site"), F.col(title_col).cast("string").alias("text"))
    return rows.where("id is not null and text is not null").mapInArrow(_titles(sent), "id bigint").distinct()


def residue_bodies(docs: DataFrame, model: Ratios, id_col: str = "id", text_col: str = "body_text") -> DataFrame:
    """(id) of the records whose text is or holds template residue.

    Defined cases: null ids and texts are no cases, nor are empty texts; a
    record delivered again counts once; an empty table gives none; texts are
    read whole; further columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.where("id is not null and text is not null").mapInArrow(_bodies(sent), "id bigint").distinct()


def found(indexable: DataFrame, extracted: DataFrame) -> DataFrame:
    """p4_found: (record_table, record_id)."""
    model = fit(indexable, extracted)
    bodies = residue_bodies(indexable, model).select(F.lit("indexable_documents").alias("record_table"), F.col("id").alias("record_id"))
    titles = residue_titles(extracted, model).select(F.lit("extracted_documents").alias("record_table"), F.col("id").alias("record_id"))
    return bodies.unionByName(titles)


def without_residue(docs: DataFrame, cases: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the records of ``cases`` (id); rows with a null id stay."""
    return docs.join(cases.select(F.col("id").alias("__case")), F.col(id_col) == F.col("__case"), "left_anti")
