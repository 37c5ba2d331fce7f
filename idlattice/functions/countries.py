"""Country codes of travel documents and their correction after OCR."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 3166-1 alpha-3 and ICAO special codes, in order.
CODES = (
    "ABW", "AFG", "AGO", "AIA", "ALA", "ALB", "AND", "ARE", "ARG", "ARM", "ASM", "ATA", "ATF", "ATG", "AUS", "AUT", "AZE", "BDI", "BEL", "BEN",
    "BES", "BFA", "BGD", "BGR", "BHR", "BHS", "BIH", "BLM", "BLR", "BLZ", "BMU", "BOL", "BRA", "BRB", "BRN", "BTN", "BVT", "BWA", "CAF", "CAN",
    "CCK", "CHE", "CHL", "CHN", "CIV", "CMR", "COD", "COG", "COK", "COL", "COM", "CPV", "CRI", "CUB", "CUW", "CXR", "CYM", "CYP", "CZE", "DEU",
    "DJI", "DMA", "DNK", "DOM", "DZA", "ECU", "EGY", "ERI", "ESH", "ESP", "EST", "ETH", "FIN", "FJI", "FLK", "FRA", "FRO", "FSM", "GAB", "GBR",
    "GEO", "GGY", "GHA", "GIB", "GIN", "GLP", "GMB", "GNB", "GNQ", "GRC", "GRD", "GRL", "GTM", "GUF", "GUM", "GUY", "HKG", "HMD", "HND", "HRV",
    "HTI", "HUN", "IDN", "IMN", "IND", "IOT", "IRL", "IRN", "IRQ", "ISL", "ISR", "ITA", "JAM", "JEY", "JOR", "JPN", "KAZ", "KEN", "KGZ", "KHM",
    "KIR", "KNA", "KOR", "KWT", "LAO", "LBN", "LBR", "LBY", "LCA", "LIE", "LKA", "LSO", "LTU", "LUX", "LVA", "MAC", "MAF", "MAR", "MCO", "MDA",
    "MDG", "MDV", "MEX", "MHL", "MKD", "MLI", "MLT", "MMR", "MNE", "MNG", "MNP", "MOZ", "MRT", "MSR", "MTQ", "MUS", "MWI", "MYS", "MYT", "NAM",
    "NCL", "NER", "NFK", "NGA", "NIC", "NIU", "NLD", "NOR", "NPL", "NRU", "NZL", "OMN", "PAK", "PAN", "PCN", "PER", "PHL", "PLW", "PNG", "POL",
    "PRI", "PRK", "PRT", "PRY", "PSE", "PYF", "QAT", "REU", "ROU", "RUS", "RWA", "SAU", "SDN", "SEN", "SGP", "SGS", "SHN", "SJM", "SLB", "SLE",
    "SLV", "SMR", "SOM", "SPM", "SRB", "SSD", "STP", "SUR", "SVK", "SVN", "SWE", "SWZ", "SXM", "SYC", "SYR", "TCA", "TCD", "TGO", "THA", "TJK",
    "TKL", "TKM", "TLS", "TON", "TTO", "TUN", "TUR", "TUV", "TWN", "TZA", "UGA", "UKR", "UMI", "URY", "USA", "UZB", "VAT", "VCT", "VEN", "VGB",
    "VIR", "VNM", "VUT", "WLF", "WSM", "YEM", "ZAF", "ZMB", "ZWE", "UTO", "UNA", "UNK", "XOM", "XXA", "XXB", "XXC", "XXX", "XPO", "GBD", "GBN",
    "GBO", "GBS", "RKS",
)
#: What a code's character may have been before OCR.
MISREAD = {"0": "O", "1": "I", "2": "Z", "5": "S", "8": "B", "6": "GB", "V": "U", "U": "V"}


@lru_cache(1)
def corrections() -> dict[str, str]:
    """Every misread code that has exactly one nearest valid code, with that code."""
    back: dict[str, set[str]] = {}
    for shown, meant in MISREAD.items():
        for letter in meant:
            back.setdefault(letter, set()).add(shown)
    near: dict[str, list[tuple[int, str]]] = {}
    for code in CODES:
        for read in product(*[[c, *sorted(back.get(c, ()))] for c in code]):
            word = "".join(read)
            if word != code:
                near.setdefault(word, []).append((sum(a != b for a, b in zip(word, code, strict=True)), code))
    valid = set(CODES)
    found = {}
    for word, options in near.items():
        least = min(options)[0]
        best = [code for distance, code in options if distance == least]
        if word not in valid and len(best) == 1:
            found[word] = best[0]
    return found


def is_country(code: Column) -> Column:
    return F.coalesce(code.isin(*CODES), F.lit(False))


@lru_cache(1)
def _lookup() -> str:
    """All misread codes, each behind a semicolon with the code that it stands for."""
    return "".join(f";{read}{code}" for read, code in sorted(corrections().items()))


def correct_country(raw: Column) -> Column:
    """The code itself if valid, its only nearest valid code if there is one, else as it was read."""
    code = F.upper(F.trim(raw))
    at = F.instr(F.lit(_lookup()), F.concat(F.lit(";"), code))
    return F.when(F.length(code) != 3, raw).when(code.isin(*CODES), code).when(at > 0, F.substring(F.lit(_lookup()), at + 4, F.lit(3))).otherwise(raw)
