"""Lookup tables: party classes, spellings, regions, stop words. All are small and fixed."""

from __future__ import annotations

import os
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

GUEST = "CONVIDADO"
NO_CLASS = "Sem classificação"
NO_REGION = "Não identificado"

# The seven classes of parties on the published 0-10 scale, and their reduction to three.
PARTY_CLASS = {
    "PSOL": "Extrema-esquerda", "PCdoB": "Extrema-esquerda", "PCB": "Extrema-esquerda", "UP": "Extrema-esquerda",
    "PT": "Esquerda", "PDT": "Esquerda", "PSB": "Esquerda", "REDE": "Esquerda", "PV": "Esquerda", "PMN": "Esquerda",
    "PPS": "Centro-esquerda", "PROS": "Centro-esquerda",
    "MDB": "Centro", "PSDB": "Centro", "CIDADANIA": "Centro", "PMDB": "Centro", "AVANTE": "Centro",
    "PSD": "Centro-direita", "PODE": "Centro-direita", "SOLIDARIEDADE": "Centro-direita", "PRD": "Centro-direita",
    "PL": "Direita", "PP": "Direita", "PROGRESSISTAS": "Direita", "REPUBLICANOS": "Direita", "UNIÃO": "Direita",
    "DEM": "Direita", "PSC": "Direita", "PRB": "Direita", "PTB": "Direita", "PR": "Direita", "PATRIOTA": "Direita", "PFL": "Direita",
    "PSL": "Extrema-direita", "NOVO": "Extrema-direita",
    "PTdoB": "Centro", "PRONA": "Extrema-direita", "PTC": "Centro-direita", "PRP": "Direita", "PMB": "Centro-direita",
    "PRTB": "Extrema-direita", "PAN": "Centro-esquerda", "PST": "Centro-direita", "PHS": "Centro-direita",
    "PPB": "Direita", "PPR": "Direita", "PDS": "Direita", "ARENA": "Direita", "PPL": "Esquerda",
    "PCO": "Extrema-esquerda", "PSTU": "Extrema-esquerda",
    "PTN": "Centro-direita", "PEN": "Direita", "MOBILIZA": "Esquerda", "AGIR": "Centro-direita",
    "PSDC": "Centro", "DC": "Centro", "MISSÃO": "Direita",
}
CLASS_3 = {
    "Extrema-esquerda": "Esquerda", "Esquerda": "Esquerda", "Centro-esquerda": "Esquerda", "Centro": "Centro",
    "Centro-direita": "Direita", "Direita": "Direita", "Extrema-direita": "Direita",
}
SPELLINGS = {
    "UNIAO": "UNIÃO", "PATRI": "PATRIOTA", "SDD": "SOLIDARIEDADE", "SD": "SOLIDARIEDADE", "SOLIDARIEDAD": "SOLIDARIEDADE",
    "PODEMOS": "PODE", "MISSAO": "MISSÃO", "S.PART.": "SEM PARTIDO", "S/PARTIDO": "SEM PARTIDO",
}
REGION = {
    "AC": "Norte", "AP": "Norte", "AM": "Norte", "PA": "Norte", "RO": "Norte", "RR": "Norte", "TO": "Norte",
    "AL": "Nordeste", "BA": "Nordeste", "CE": "Nordeste", "MA": "Nordeste", "PB": "Nordeste", "PE": "Nordeste", "PI": "Nordeste", "RN": "Nordeste", "SE": "Nordeste",
    "DF": "Centro-Oeste", "GO": "Centro-Oeste", "MT": "Centro-Oeste", "MS": "Centro-Oeste",
    "ES": "Sudeste", "MG": "Sudeste", "RJ": "Sudeste", "SP": "Sudeste", "PR": "Sul", "RS": "Sul", "SC": "Sul",
}
#: Party names that are common words and stay in vocabularies.
COMMON_PARTY_WORDS = frozenset("agir cidadania missão missao mobiliza novo rede solidariedade união uniao podemos pode".split())

#: A class map for collections whose parties the published scale does not know; a parameter of every query.
INVENTED_CLASS = {
    "PDAB": "Esquerda", "FEIRA": "Esquerda", "PTERR": "Extrema-esquerda", "PMAL": "Centro-esquerda", "CAMPINA": "Esquerda", "PORB": "Centro-esquerda",
    "PLUM": "Centro", "VERTENTE": "Centro", "PMAR": "Centro", "PRUMO": "Centro", "ELOS": "Centro",
    "UNAR": "Direita", "PROA": "Centro-direita", "LIRÃO": "Direita", "PNOR": "Direita", "PAZUL": "Extrema-direita", "RUMOS": "Centro-direita", "PCER": "Direita", "ALVO": "Direita", "PSALV": "Extrema-direita",
}

#: Stop words of the domain; a longer list can be named in CORPUSLOOM_STOPWORDS, one word a line.
DOMAIN_STOPWORDS = frozenset(
    """presidente presidenta deputado deputada deputados deputadas senhor senhora senhores senhoras senador senadora ministro ministra orador oradora
    parlamentar relator sr sra srs sras câmara plenário sessão congresso senado comissão governo brasil estado país república federal nacional
    projeto lei artigo emenda votação voto matéria proposta discurso falar dizer disse obrigado obrigada tarde todos hoje ainda também
    nobres colegas excelência tribuna palavra aparte tempo minuto favor""".split()
)
#: Portuguese function words of four letters and more, and the short ones.
FUNCTION_WORDS = frozenset(
    """a à ao aos as às com da das de do dos e em entre era essa esse esta este eu foi há isso já mais mas me mesmo muito na nas nem no nos não o os ou
    para pela pelas pelo pelos por porque quando que quem se sem ser seja sobre sua seu são só também te tem um uma até como depois desde embora demais
    isto aquele aquela eles elas nós você vocês minha meu nossa nosso onde qual quais será serão sido tinha está estão estava foram havia tudo toda todo""".split()
)


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_values(pairs: dict[str, str], name: str, a: str, b: str) -> str:
    """A map as a SQL table, for the SQL twins of the queries."""
    return f"{name}({a}, {b}) AS (VALUES {', '.join(f'({_sql(k)}, {_sql(v)})' for k, v in pairs.items())})"


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """A literal map, inlined in the plan: no join for tables this small."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def canonical_spellings(classes: dict[str, str] | None = None) -> dict[str, str]:
    """Upper-cased spelling -> party name: the known spellings and every party's own name."""
    names = {**PARTY_CLASS, **(classes or {})}
    return {**{p.upper(): p for p in names}, **SPELLINGS, GUEST: GUEST, "SEM PARTIDO": "SEM PARTIDO"}


def classes_3(classes: dict[str, str] | None = None) -> dict[str, str]:
    return {p: CLASS_3[c] for p, c in {**PARTY_CLASS, **(classes or {})}.items()}


@cache
def stopwords() -> frozenset[str]:
    words = set(FUNCTION_WORDS | DOMAIN_STOPWORDS)
    path = os.environ.get("CORPUSLOOM_STOPWORDS")
    if path:
        with open(path, encoding="utf-8") as f:
            words |= {line.strip().lower() for line in f if line.strip() and not line.startswith("#")}
    return frozenset(words)


def party_words(classes: dict[str, str] | None = None) -> frozenset[str]:
    """Party names as they would appear as tokens, without those that are common words."""
    names = {*PARTY_CLASS, *(classes or {}), *SPELLINGS, *SPELLINGS.values()}
    return frozenset(n.lower() for n in names if len(n) >= 2 and n.isalpha()) - COMMON_PARTY_WORDS


def spectrum_of(party: str, classes: dict[str, str] | None = None) -> str:
    """The seven-way class of one party name."""
    name = canonical_spellings(classes).get(party.strip().upper(), party.strip())
    return {**PARTY_CLASS, **(classes or {})}.get(name, NO_CLASS)


#: Later names of parties. Off by default, since a renamed party is another party in time.
RENAMED = {"PFL": "UNIAO", "DEM": "UNIAO", "PTN": "PODE", "PMR": "REPUBLICANOS", "PSL": "UNIAO", "PMDB": "MDB", "PTdoB": "AVANTE", "PHS": "PODE", "SOLIDARIEDAD": "SOLIDARIEDADE", "PEN": "PATRIOTA", "PPB": "PROGRESSISTAS", "PCDOB": "PCdoB"}


def renamed(party: Column) -> Column:
    """A party under its later name, others unchanged."""
    return F.coalesce(lookup(RENAMED, party), party)
