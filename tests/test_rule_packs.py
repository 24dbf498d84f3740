"""Rule packs: loading with override, entries that are left out, thousands of rules at run time, values of fields and secrets."""

import json

import pytest

from docsieve.operators import fields
from docsieve.sources import rule_packs

SCHEMA = "doc_id long, text string, rule string, left string, found string, value string, line string"


def _pack(code, **lists):
    return json.dumps({"code": code, "label": code, "aliases": [code.lower() + "land"], **lists})


def _docs(spark, *texts):
    return spark.createDataFrame([(k, t, "r", "l", "f", "v", "n") for k, t in enumerate(texts)], SCHEMA)


def _rows(df):
    return sorted((r["doc_id"], r["rule"], r["matched_text"]) for r in df.collect())


def test_own_packs_have_no_problems():
    packs = rule_packs.load()
    assert packs.problems == [] and len(packs.fields) > 40 and packs.aliases["PRC"] == "CN" and packs.aliases["UAE"] == "AE"
    assert not packs.of("SG").patterns == [] and {f.pack for f in packs.of("SG", "HK").fields} == {"SG", "HK"}


def test_later_packs_replace_earlier_ones_and_wrong_entries_are_reported(spark, tmp_path):
    folder = tmp_path / "more"
    folder.mkdir()
    good = {"rule": "uk_staff", "severity": "low", "labels": ["staff no"], "shape": "[0-9]{4}"}
    bad = [{**good, "severity": "worst"}, {**good, "shape": "[0-9"}, {**good, "labels": []}, {**good, "check": "none such"}, {**good, "labels": ["", 3]}, "text", {"rule": "x"}]
    (folder / "a.json").write_text(_pack("uk", fields=[good, *bad]), encoding="utf-8")
    (folder / "b.json").write_text("{not json", encoding="utf-8")
    (folder / "c.json").write_text('["a list"]', encoding="utf-8")
    (folder / "readme.txt").write_text("no pack", encoding="utf-8")
    packs = rule_packs.load(spark, f"file://{folder}")
    assert [f.rule for f in packs.of("UK").fields] == ["uk_staff"] and packs.aliases["UKLAND"] == "UK"
    assert len(packs.problems) == len(bad) + 2 and {p[2].split(":")[0] for p in packs.problems} >= {"severity worst", "not a pack", "check none such", "not an object", "without labels"}
    assert len(packs.fields) > 40
    assert _rows(fields.review(_docs(spark, "Staff  No: 1234 and NIN AB123456C", None, ""), packs.of("UK"))) == [(0, "uk_staff", "1234")]


def test_thousands_of_rules_in_one_lexicon(spark):
    own = [{"rule": f"rule_{k}", "severity": "low", "labels": [f"field {k}", f"fld{k}"], "shape": "[A-Z]{2}[0-9]+"} for k in range(3000)]
    packs = rule_packs.parse([("many", _pack("many", fields=own))])
    texts = [f"Field {k}: AB{k}, fld{k + 1} ZZ9 field {k + 2} none" for k in range(0, 2900, 29)]
    expected = sorted(x for i, k in enumerate(range(0, 2900, 29)) for x in ((i, f"rule_{k}", f"AB{k}"), (i, f"rule_{k + 1}", "ZZ9")))
    assert _rows(fields.review(_docs(spark, *texts), packs)) == expected


@pytest.mark.parametrize(
    "code, text, found",
    [
        ("HK", "HKID is AB123456(9), HKID A123456(3)", [("hk_hkid", "A123456(3)"), ("hk_hkid", "AB123456(9)")]),
        ("HK", "HKID A123456(4)", []),
        ("UK", "NI No. ab 12 34 56 c", [("uk_nin", "ab 12 34 56 c")]),
        ("UK", "NINo BG123456A, NIN: BG123456A", []),
        ("US", "078-05-1120 and 219-09-9999, 123-45-6789; EIN 07-1234567", [("us_ssn", "123-45-6789")]),
        ("SG", "[2021] SGHC(A) 12, [21] SGHC 4; MCST No. 1234; Lot Number of MK12 01234X", [("sg_court_citation", "[2021] SGHC(A) 12"), ("sg_sla_lot_number", "MK12 01234X"), ("sg_sla_title_plan_number", "1234")]),
        ("SG", "SGX ticker d05, SGX ticker D05", [("sg_sgx_counter", "D05")]),
        ("AE", "Trade Licence No. CN-1234567, DED CONTACT", [("ae_trade_licence", "CN-1234567")]),
        ("JP", "個人番号123456789018、〒 100-0001", [("jp_my_number", "123456789018"), ("jp_postal_code", "100-0001")]),
        ("CN", "身份证号码11010519491231002X", [("cn_resident_id", "11010519491231002X")]),
        ("RECORDS", "device serial number ABC1234\nsample laptop S/N ABC1234", [("device_serial_number", "ABC1234")]),
        ("RECORDS", "CIF No. X1234567; CIF No. UNKNOWN", [("bank_customer_reference", "CIF No. X1234567")]),
        ("RECORDS", "VAT no. DE000000000, VAT ID DE123456789", [("eu_company_id", "DE123456789")]),
        ("RECORDS", "id 0a1b2c3d-0a1b-4a1b-8a1b-0a1b2c3d4e5f_session", [("internal_session_id", "0a1b2c3d-0a1b-4a1b-8a1b-0a1b2c3d4e5f_session")]),
        ("RECORDS", "Strata Titles Boards case: STB-12-2020", [("sg_tribunal_reference", "STB-12-2020")]),
    ],
)
def test_values(spark, code, text, found):
    assert sorted(x[1:] for x in _rows(fields.review(_docs(spark, text), rule_packs.load().of(code)))) == found


def test_secrets(spark):
    packs = rule_packs.load()
    text = "api_key = qW3rT6yU8iO0 token: aaaaaaaaaaaaaa\npassword changeme1234 key 0123456789abcdef0123456789abcdef\nsecret\nqW3rT6yU8iO0 redis://u:hunter22@h redis://u:password@h"
    assert _rows(fields.secrets(_docs(spark, text, None, ""), packs.secrets)) == [(0, "connection_password", "://u:hunter22@"), (0, "setting_hex", "0123456789abcdef0123456789abcdef"), (0, "setting_secret", "qW3rT6yU8iO0")]
    twice = "token token: qW3rT6yU8iO0"
    assert _rows(fields.secrets(_docs(spark, twice), packs.secrets)) == [(0, "setting_secret", "qW3rT6yU8iO0")]
