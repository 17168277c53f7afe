"""Problem 5: transcripts into clean, ordered speaker turns.

One Aho-Corasick pass finds where labels, fillers and annotations may begin;
context rules decide what each hit is (a name in capitals with a colon is a label
only if it names somebody, "é..." is a filler but "é" is not). Labels cut the text into
segments, interval subtraction takes annotations, times and fillers out of them,
and windows over the segments drop the empty ones, join neighbours of one
speaker and number turns and speakers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.encoding import repair
from corpusloom.llm.words import plain

#: Titles, fillers and annotations of the transcripts.
TITLES = ("O SR. ", "A SRA. ", "O Sr. ", "A Sra. ", "Dep. ", "DEP. ", "Sr. ", "Sra. ", "Deputado ", "Deputada ")
FILLERS = ("é...", "é…", "éh...", "ãh...", "ah...", "ahn...", "hum...", "ãh,", "hã,", "ahn,", "hum,", "né,", "tipo assim,", "bom, é...", "éééé,", "ééé,", "éé,", "eh,", "uh,")
ANNOTATIONS = (
    "palmas", "aplausos", "risos", "riso", "pausa", "soa a campainha", "campainha", "inaudível", "ininteligível", "tumulto", "vaias", "apupos",
    "microfone", "interrupção", "ruído", "tosse", "manifestação", "muito bem", "apoiado", "silêncio", "música", "intervenção fora", "não identificado",
)
#: Capitals before a colon that name nobody.
NO_NAME = frozenset(
    """PERGUNTO INSISTO REPITO CONVÉM LEMBRAR DISSE DIGO AFIRMO ATENÇÃO NOTA OBSERVAÇÃO AVISO CONCLUSÃO RESUMO EXEMPLO QUESTÃO RESPOSTA PERGUNTA TEMA ASSUNTO
    ITEM ARTIGO ORDEM DIA PAUTA DATA HORA LOCAL SESSÃO UMA UM QUE NÃO SE PORQUE MAS COM SEM PARA POR EM NO NA NOS NAS AO AOS AS OS O A E É FOI SÃO
    MORADORA MORADOR VERDADE RESULTADO IMPORTANTE URGENTE SEGUE""".split()
)
CHAIR = frozenset({"PRESIDENTE", "PRESIDENTA"})

_U, _L = "A-ZÁÀÂÃÉÈÊÍÏÓÔÕÚÜÇ", "a-záàâãéèêíïóôõúüç"
_WORD = rf"[{_U}�?][{_U}{_L}'’�?-]*\.?"
_NAME = rf"{_WORD}(?: (?:d[aeo]s? |e )?{_WORD}){{0,7}}"
_PAREN = r"\s?\((?P<paren>[^()\n]{1,120})\)"
_DASH = re.compile(rf"(?P<name>{_NAME})(?:{_PAREN})?\s?[-–—]\s?")
_COLON = re.compile(rf"(?P<name>{_NAME})(?:{_PAREN})?\s?:(?!\d)\s?")
_BRACKET = re.compile(rf"\[(?P<name>{_NAME})\]:?\s?")
_CAPS = re.compile(rf"(?<![\w.,-])(?P<name>[{_U}�?][{_U}'’�?.-]*(?: [{_U}�?][{_U}'’�?.-]*){{0,7}})(?:\s?\((?P<paren>[^()\n]{{1,120}})\))?$")
_TIMES = (
    re.compile(r"[\[(]\d{1,3}(?::\d\d){1,2}[\])]|[\[(]\d{1,4}\s?(?:min|m)\s?\d{0,2}\s?s?[\])]|[\[(]\d{1,2}h\d{0,2}(?:min)?[\])]|[\[(]\d{1,6}s[\])]"),
    re.compile(r"<\d{1,6}s>|<\d{1,3}(?::\d\d){1,2}>"),
)
_CLOCK = re.compile(r"\d{1,2}:\d\d:\d\d(?:\s?[-–—])?\s?")
_HOUR = re.compile(r"(\d{1,2}):(?=\d\d:\d\d)")
_NOTE = {"(": re.compile(r"\(([^()\n]{1,80})\)"), "[": re.compile(r"\[([^\[\]\n]{1,80})\]"), "{": re.compile(r"\{([^{}\n]{1,80})\}"), "<": re.compile(r"<<?([^<>\n]{1,80})>>?"), "*": re.compile(r"\*([^*\n]{1,40})\*")}


@cache
def _machine() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in TITLES:
        a.add_word(t, ("title", len(t)))
    for f in FILLERS:
        a.add_word(f, ("filler", len(f)))
    for note in ANNOTATIONS:
        for form in {note, note.capitalize(), note.upper()}:
            a.add_word(form, ("note", len(form)))
    for c in "([{<*:":
        a.add_word(c, (c, 1))
    a.make_automaton()
    return a


def name_key(name: str) -> tuple[str, ...]:
    """Upper-case words without accents; titles, dots and particles dropped."""
    words = re.findall(r"[A-Z0-9�?'-]+", plain(name).upper())
    while words and words[0] in ("O", "A", "SR", "SRA", "DEP", "DEPUTADO", "DEPUTADA"):
        words = words[1:]
    return tuple(w for w in words if w not in ("DE", "DA", "DO", "DAS", "DOS", "E"))


def _word_fits(short: str, full: str) -> bool:
    if short == full or (len(short) == 1 and full[:1] == short):
        return True
    return len(short) == len(full) and ("�" in short + full or "?" in short + full) and all(a == b or a in "�?" or b in "�?" for a, b in zip(short, full))


def same_speaker(short: tuple[str, ...], full: tuple[str, ...]) -> bool:
    """The words of the shorter label stand in the fuller one in order, initials allowed, and both end alike."""
    if len(short) > len(full):
        short, full = full, short
    if not short or len(short[-1]) == 1 or not _word_fits(short[-1], full[-1]):
        return False
    at = 0
    for w in short:
        while at < len(full) and not _word_fits(w, full[at]):
            at += 1
        if at == len(full):
            return False
        at += 1
    return True


class _Labels:
    """The labels of one transcript, with who each of them means."""

    def __init__(self, main: tuple[str, ...] = (), speaker: str | None = None) -> None:
        self.main, self.speaker = main, speaker
        self.people: list[tuple[str, ...]] = []
        self.names: list[str] = []
        self.chair: list[tuple[str, ...]] = []
        self.chair_no: int | None = None

    def known(self, key: tuple[str, ...]) -> int | None:
        for i, p in enumerate(self.people):
            if p == key:
                return i
        for i in reversed(range(len(self.people))):
            if self.people[i] and same_speaker(key, self.people[i]):
                return i
        return None

    def who(self, name: str, key: tuple[str, ...]) -> int:
        if key[0] in CHAIR or any(same_speaker(key, c) for c in self.chair):
            if self.chair_no is None:
                self.chair_no = len(self.people)
                self.people.append(())
                self.names.append("PRESIDENTE")
            return self.chair_no
        i = self.known(key)
        if i is None:
            i = len(self.people)
            self.people.append(key)
            own = len(self.main) > 1 and len(key) <= len(self.main) and same_speaker(key, self.main)
            self.names.append(re.sub(r"\s+", " ", self.speaker if own else name).strip())
        elif len(key) > len(self.people[i]):
            self.people[i], self.names[i] = key, name.strip()
        return i


def segments(text: str, speaker: str | None = None) -> list[tuple[str, int, int, list[tuple[int, int]], list[tuple[int, int]]]]:
    """(speaker name, number, start, end, silent spans, fillers) of each labelled passage, in order.

    ``text`` must have its accents composed and its encoding repaired. ``speaker``
    is the speech's main speaker: a short label that fits this name is one, and the
    name stands for that speaker.
    """
    main = name_key(prepared(speaker)) if speaker else ()
    hits = [(end - size + 1, end, kind) for end, (kind, size) in _machine().iter(text)]
    notes = {at for at, _, kind in hits if kind == "note"}

    def is_note(at: int, stop: int) -> bool:
        while at < stop and text[at].isspace():
            at += 1
        return at == stop or at in notes

    found: list[tuple[int, int, str, str | None, bool]] = []
    silent: list[tuple[int, int]] = []
    fillers: list[tuple[int, int]] = []
    for at, end, kind in hits:
        if kind == "note":
            continue
        if kind == "title":
            if at and (text[at - 1].isalnum() or text[at - 1] in ".,") or text[at - 2 : at] in ("O ", "A ") and text[at : at + 2] in ("Sr", "SR"):
                continue
            m = (_DASH.match(text, end + 1) if text[at] in "OA" else None) or _COLON.match(text, end + 1)
            if m and (m["name"].rstrip(".") not in ("Presidente", "Presidenta") or text[at] in "OA"):
                found.append((at, m.end(), m["name"], m["paren"], True))
        elif kind == "filler":
            if (at == 0 or not text[at - 1].isalpha()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                fillers.append((at, end + 1))
        elif kind == ":":
            clock = _HOUR.search(text, max(0, at - 2), end + 6)
            if clock and (m := _CLOCK.match(text, clock.start())) and (clock.start() == 0 or not text[clock.start() - 1].isdigit()):
                silent.append((m.start(), m.end()))
                continue
            if at and (text[at - 1] in _UPPER_SET):
                m = _CAPS.search(text, max(0, at - 110), at)
                if m:
                    words = m["name"].split()
                    if not any(w.strip(".") in NO_NAME for w in words):
                        stop = end + 1 + (text[end + 1 : end + 2] in (" ", "\n"))
                        found.append((m.start(), stop, m["name"], m["paren"], len(words) > 1 or words[0] in CHAIR))
        else:
            m = _TIMES[kind == "<"].match(text, at) if kind in "[(<" else None
            if m:
                silent.append((m.start(), m.end()))
                continue
            if kind == "[" and (m := _BRACKET.match(text, at)) and not is_note(m.start("name"), m.end("name")):
                found.append((at, m.end(), m["name"], None, True))
            elif (m := _NOTE[kind].match(text, at)) and (kind in "{<*" or kind == "[" and m[1][:1].islower() or is_note(m.start(1), m.end(1))):
                silent.append((m.start(), m.end()))
    labels = _Labels(main, speaker)
    for _, _, name, paren, _ in found:
        key = name_key(name)
        if key and key[0] in CHAIR and paren:
            inner = name_key(paren.split(".")[0])
            if len(inner) >= 2:
                labels.chair.append(inner)
    out: list[list] = []
    last = -1
    for at, stop, name, paren, sure in sorted(found, key=lambda x: (x[0], -x[1])):
        key = name_key(name)
        if at < last or not key:
            continue
        if not sure and labels.known(key) is None and not any(same_speaker(key, c) for c in labels.chair) and not (len(main) > 1 and same_speaker(key, main)):
            continue
        if out:
            out[-1][3] = at
        no = labels.who(name, key)
        out.append([no, no, stop, len(text)])
        last = stop
    return [(labels.names[no], no, a, b, [s for s in silent if a <= s[0] < b], [f for f in fillers if a <= f[0] < b]) for no, _, a, b in out]


_UPPER_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZÁÀÂÃÉÈÊÍÏÓÔÕÚÜÇ�?)")


def subtract(text: str, start: int, end: int, spans: list[tuple[int, int]]) -> str:
    """The text of an interval without the spans, white space made single."""
    out, at = [], start
    for a, b in sorted(spans):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    if at < end:
        out.append(text[at:end])
    return re.sub(r"\s+([,.;:?!])", r"\1", re.sub(r"\s+", " ", " ".join(out))).strip(" -–—")


def prepared(text: str) -> str:
    """Encoding repaired, accents composed."""
    text = repair(text)
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def _cut(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r, i, text, speaker in zip(pdf["row"], pdf["id"], pdf["discurso"], pdf["orador"]):
                t = prepared(text)
                for pos, (name, no, a, b, silent, fillers) in enumerate(segments(t, speaker)):
                    spoken = subtract(t, a, b, silent)
                    if any(c.isalnum() for c in spoken):
                        out.append((r, i, pos, no, name if with_text else None, subtract(t, a, b, silent + fillers) if with_text else None))
            yield pd.DataFrame(out, columns=["row", "id", "pos", "who", "speaker", "spoken"])

    return run


def turns(speeches: DataFrame, with_text: bool = True) -> DataFrame:
    """(id, turn_no, speaker_no[, speaker, spoken]): the turns of every speech with a label.

    Null, blank and unlabelled texts give no rows; repeated ids are numbered
    each by itself. ``spoken`` is the text without times, annotations and fillers.
    Labels are sought in the repaired text only: the stored one may hide them.
    """
    s = speeches.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), "discurso", "orador").filter(F.col("discurso").isNotNull())
    seg = s.mapInPandas(_cut(with_text), "row long, id long, pos int, who int, speaker string, spoken string")
    by_pos = Window.partitionBy("row", "id").orderBy("pos")
    change = F.when(F.lag("who").over(by_pos).eqNullSafe(F.col("who")), 0).otherwise(1)
    seg = seg.withColumn("change", change).withColumn("turn_no", F.sum("change").over(by_pos))
    if with_text:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "spoken"))), lambda x: x["spoken"]), " ")
        t = seg.groupBy("row", "id", "turn_no", "who").agg(F.min_by("speaker", "pos").alias("speaker"), joined.alias("spoken"))
    else:
        t = seg.filter("change = 1").select("row", "id", "turn_no", "who")
    first = F.min("turn_no").over(Window.partitionBy("row", "id", "who"))
    number = F.dense_rank().over(Window.partitionBy("row", "id").orderBy("first"))
    t = t.withColumn("first", first).withColumn("speaker_no", number)
    more = ["speaker", "spoken"] if with_text else []
    return t.select("id", F.col("turn_no").cast("long").alias("turn_no"), F.col("speaker_no").cast("long").alias("speaker_no"), *more)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark.read.parquet(f"{sf_dir}/speeches.parquet"), with_text=False).distinct()


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark.read.parquet(f"{sf_dir}/speeches.parquet"))


QUERIES = {"p5_found": found, "p5_turns": report}
SQL: dict[str, str] = {}
