"""Small made-up study files with the oddities the readers and merges must survive."""

import csv
import random

VISITS = ["VISIT", "VISITNUM", "VISITDY", "EPOCH"]
ARMS = ["ARTEMETHER LUMEFANTRINE", "Amodiaquine Artesunate", "DIHYDROARTEMISININ PIPERAQUINE", "CHLOROQUINE", "NA"]
CODES = ["AL", "AL_adult", "ASAQ", "DP", "SP", "CQ", "ASMQ", "NA", "ODD"]
DAYS = [0, 1, 2, 3, 7, 28, 42]


def _write(path, header, rows, encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows([["NA" if v is None else v for v in r] for r in rows])
    return str(path)


def write_study(folder, subjects=40, seed=11):
    """Write all files and return their paths by name."""
    rng = random.Random(seed)
    people = [(f"ST{i % 4}", f"ST{i % 4}-{i:03d}") for i in range(subjects)]
    files = {}

    dm = [
        [s, u, "DM", rng.choice([2, 4, 30, 60, None]), rng.choice(["YEARS", "MONTHS", None]), rng.choice("FMU"), rng.choice(ARMS), rng.choice(["KEN", "UGA", "XXX"])]
        for s, u in people
    ]
    files["DM"] = _write(folder / "DM 2025.csv", ["STUDYID", "USUBJID", "DOMAIN", "AGE", "AGEU", "SEX", "ARM", "COUNTRY"], dm)

    def findings(code, tests, extra=lambda: [], header=(), share=1.0):
        rows, seq = [], 0
        for s, u in people:
            for day in DAYS:
                if rng.random() > share:
                    continue
                for test, unit, value in tests:
                    seq += 1
                    v = value()
                    number = v if isinstance(v, (int, float)) else None
                    rows.append([s, u, code, seq, test, v, unit, v, number, unit, *extra(), f"V{day}", day, rng.choice([day + 1, day + 1, "unknown"]), "TREATMENT"])
                    if rng.random() < 0.1:
                        rows.append(rows[-1][:3] + [seq + 10_000] + rows[-1][4:])
        names = [f"{code}{c}" for c in ("SEQ", "TESTCD", "ORRES", "ORRESU", "STRESC", "STRESN", "STRESU")]
        files[code] = _write(folder / f"{code} 2025.csv", ["STUDYID", "USUBJID", "DOMAIN", *names, *header, *VISITS], rows)

    def density():
        return rng.choice([0, 40, 900, 25_000, 120_000.5, None])

    mb_extra = ["MBMETHOD", "MBLOC", "MBHR", "MBDY", "MBSTDY", "MBEVLINT", "MBEVINTX"]
    findings(
        "MB",
        [("PFALCIPA", "10^6/L", density), ("PFALCIPS", "10^6/L", density), ("OTHER", None, density)],
        lambda: [rng.choice(["MICROSCOPY", "PCR"]), None, None, rng.choice([1, 1, 2, 3, 8, 29, None]), None, None, None],
        mb_extra,
    )
    findings("PF", [("INTP", None, lambda: rng.choice(["RECRUDESCENCE", "REINFECTION", None]))], share=0.3)
    findings("RS", [("WHOMAL01", None, lambda: rng.choice(["ACPR", "LATE TREATMENT FAILURE", "LATE PARASITOLOGICAL FAILURE"]))], share=0.4)
    findings("VS", [("WEIGHT", "kg", lambda: rng.uniform(5, 20)), ("HEIGHT", "cm", lambda: rng.uniform(60, 110)), ("TEMP", "C", lambda: rng.uniform(36, 40))], share=0.6)

    terms = ["ACPR", "LATE CLINICAL FAILURE", "LOST TO FOLLOW-UP", "WITHDREW CONSENT", "ETF", "COMPLETED", None]
    ds = [[s, u, "DS", i, rng.choice(terms), None, rng.choice(terms), "END", 9, rng.choice([1, 29, 43]), "TREATMENT"] for i, (s, u) in enumerate(people * 2)]
    files["DS"] = _write(folder / "DS 2025.csv", ["STUDYID", "USUBJID", "DOMAIN", "DSSEQ", "DSTERM", "DSMODIFY", "DSDECOD", *VISITS], ds)

    given = [[s, u, "IN", i, "drug", None, rng.choice(["ANTIMALARIAL", "OTHER"]), "mg", None, "V0", 0, 1, "TREATMENT"] for i, (s, u) in enumerate(people * 2)]
    files["IN"] = _write(folder / "IN 2025.csv", ["STUDYID", "USUBJID", "DOMAIN", "INSEQ", "INTRT", "INDECOD", "INCLAS", "INDOSU", "DOTIND", *VISITS], given)

    patients = [(f"Q{i:03d}", f"OB{i % 3}", ["Kisumu", "Lambaréné", "Côte"][i % 3], CODES[i % len(CODES)], rng.choice([0.5, 3, 4, 9, None])) for i in range(subjects)]
    keys = ["pid", "sid", "site", "dayofobs", "hourofobs"]

    def observed(name, header, values, share, day_names=("dayofobs", "hourofobs")):
        rows = []
        for pid, sid, site, code, age in patients:
            for day in [-1, *DAYS]:
                if rng.random() <= share:
                    rows.append([pid, sid, site, day, rng.choice([0, None]), *values(code, age)])
                    if rng.random() < 0.1:
                        rows.append(rows[-1])
        files[name] = _write(folder / f"{name} new.csv", [*keys[:3], *day_names, *header], rows, "latin-1")

    observed("subject", ["id", "disease", "ageyears", "gender"], lambda c, a: ["i1", "malaria", a, rng.choice(["F", "M", ""])], 0.8)
    observed("clinical", ["id", "disease", "temp", "weight", "height", "lastdayfup"], lambda c, a: ["i2", "fever", 38.5, 12, 90, rng.choice(["28", "NA", "x"])], 0.7)
    observed("parasitaemia", ["id", "pfmicl", "gfmicl"], lambda c, a: ["i3", rng.choice(["0", "500", "150000", "NA", "n/d"]), "0"], 0.9)
    observed("pcr", ["pcr"], lambda c, a: [rng.choice(["RC", "RI", None])], 0.2)
    observed("treatment", ["treat"], lambda c, a: [c], 0.5, ("dayoftreat", "houroftreat"))

    outcomes = ["ACPR", "LTFRC", "LTFRI", "MissedD28", "LowHb", None]
    chosen = [[sid, pid, site, code, outcomes[i % 6], age, rng.choice([28, 42, 7]), rng.choice(["18000", "300000", "NA"])] for i, (pid, sid, site, code, age) in enumerate(patients)]
    files["patients"] = _write(folder / "patient set.csv", ["sid", "pid", "site", "treat", "outcome", "ageyears", "lastday", "pfmicl0"], chosen, "latin-1")
    files["countries"] = _write(folder / "countries.csv", ["studyid", "usubjid", "country_name"], [[s, u, "Kenya"] for s, u in people[::3]] + [[*people[0], "Uganda"]])
    files["registry"] = _write(folder / "registry.csv", ["sid", "sid_inv", "data_format", "pubmed"], [[f"OB{i}", f"inv{i}" if i else None, "Mapped", str(i)] for i in range(5)])
    return files
