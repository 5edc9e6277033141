"""Declared columns of the study tables, in the case the files use."""

from __future__ import annotations

_SUBJECT = "STUDYID string, USUBJID string, DOMAIN string"
_VISIT = "VISIT string, VISITNUM double, VISITDY double, EPOCH string"


def _findings(code: str, extra: str = "") -> str:
    result = (
        f"{code}SEQ int, {code}TESTCD string, {code}ORRES string, {code}ORRESU string, "
        f"{code}STRESC string, {code}STRESN double, {code}STRESU string"
    )
    return ", ".join(part for part in (_SUBJECT, result, extra, _VISIT) if part)


DOMAINS = {
    "DM": f"{_SUBJECT}, AGE double, AGEU string, SEX string, ARM string, COUNTRY string",
    "DS": f"{_SUBJECT}, DSSEQ int, DSTERM string, DSMODIFY string, DSDECOD string, {_VISIT}",
    "IN": f"{_SUBJECT}, INSEQ int, INTRT string, INDECOD string, INCLAS string, INDOSU string, DOTIND string, {_VISIT}",
    "MB": _findings(
        "MB",
        "MBMETHOD string, MBLOC string, MBHR double, MBDY double, MBSTDY double, MBEVLINT string, MBEVINTX string",
    ),
    "PF": _findings("PF"),
    "PT": f"{_SUBJECT}, PTSEQ int, PTTRT string, {_VISIT}",
    "RS": _findings("RS"),
    "SA": f"{_SUBJECT}, SASEQ int, SATERM string, SADECOD string, {_VISIT}",
    "VS": _findings("VS"),
    "TI": "STUDYID string, DOMAIN string, IETESTCD string, IETEST string",
    "TS": "STUDYID string, DOMAIN string, TSSEQ int, TSPARMCD string, TSVAL string",
    "TV": "STUDYID string, DOMAIN string, VISITNUM double, VISIT string, VISITDY double",
}

_OBSERVED = "pid string, sid string, site string, dayofobs int, hourofobs int"

OBSERVATIONS = {
    "subject": f"{_OBSERVED}, id string, disease string, ageyears double, gender string",
    "clinical": f"{_OBSERVED}, id string, disease string, temp double, weight double, height double, lastdayfup string",
    "parasitaemia": f"{_OBSERVED}, id string, pfmicl string, gfmicl string",
    "pcr": f"{_OBSERVED}, pcr string",
    "treatment": "pid string, sid string, site string, dayoftreat int, houroftreat int, treat string",
}

PATIENT_SET = (
    "sid string, pid string, site string, treat string, outcome string, ageyears double, lastday int, "
    + ", ".join(f"{p}micl{i} string" for p in ("pf", "pv") for i in range(4))
    + ", "
    + ", ".join(f"FlgDV{i} string" for i in (1, 2, 3, 4, 11, 13, 15, 16, 17, 18, 19, 20))
    + ", "
    + ", ".join([f"FlgEF{i} string" for i in range(1, 6)] + [f"FlgPCR{i} string" for i in range(1, 5)])
    + ", pardens string, pardenslast string, recurparday string, fspecies string, "
    "StatAdjusted string, StatUnadjusted string, dateConverted string"
)

REGISTRY = "sid string, sid_inv string, data_format string, pubmed string"
COUNTRIES = "studyid string, usubjid string, country_name string"
