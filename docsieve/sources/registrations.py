"""Generated text: customers rendered as registration sheets, with an identifier of each kind that jurisdiction packs know. About one checksum in ten or thirty is right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.sources import tables


def _number(digits: int, salt: int) -> str:
    """So many digits, different for each customer."""
    return f"lpad(CAST((CAST(c_custkey AS BIGINT) * {salt} + {salt // 7}) % {10**digits} AS STRING), {digits}, '0')"


def _letter(salt: int, alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> str:
    return f"substr('{alphabet}', CAST((CAST(c_custkey AS BIGINT) * {salt}) % {len(alphabet)} AS INT) + 1, 1)"


_LINES = [
    "'[2021] SGHC '", _number(3, 7919), "', PayNow ID: '", _number(8, 86028121), "'K, MAS licence CMS'", _number(6, 611953), "', SGX counter D'", _number(2, 31), "'\n'",
    "'Trade Mark No. T'", _number(7, 5915587), "'B, filing no. C'", _number(9, 322255), "', resale case number RS'", _number(7, 179424), "'\n'",
    "'ITIN 9'", _number(2, 37), "'-'", _number(2, 61), "'-'", _number(4, 7907), "', FEIN '", _number(2, 53), "'-'", _number(7, 6127411), "'\n'",
    "'National Insurance Number '", _letter(5), _letter(11), _number(6, 746773), "'C, ACN '", _number(9, 413158511), "', Sydney NSW '", _number(4, 6983), "'\n'",
    "'HKID '", _letter(7), _number(7, 7368787), "', CR No. '", _number(8, 47094), "'\n'",
    "'My Number '", _number(12, 32416190071), "', Corporate Number '", _number(13, 432416187567), "', postal code '", _number(3, 97), "'-'", _number(4, 5393), "'\n'",
    "'RRN '", _number(6, 900001), "'-'", _number(7, 8675309), "', business reg. no. '", _number(3, 101), "'-'", _number(2, 17), "'-'", _number(5, 65537), "'\n'",
    "'Aadhaar '", _number(4, 4241), "' '", _number(4, 3571), "' '", _number(4, 9973), "', GSTIN 29ABCPE'", _number(4, 2711), "'F1Z5, EPIC KLM'", _number(7, 15485), "'\n'",
    "'Emirates ID 784-1987-'", _number(7, 99991), "'-1, UAE passport N'", _number(8, 13331), "', national ID 1'", _number(9, 433494437), "', Iqama 2'", _number(9, 514229), "', commercial registration '", _number(10, 4093082899), "'\n'",
    "'MyKad '", _number(6, 28657), "'-14-'", _number(4, 1597), "', NIK '", _number(16, 27644437), "', Thai ID '", _number(1, 3), "'-'", _number(4, 6089), "'-'", _number(5, 46337), "'-'", _number(2, 71), "'-'", _number(1, 7), "'\n'",
    "'PhilSys '", _number(4, 4243), "'-'", _number(4, 4253), "'-'", _number(4, 4259), "', TIN '", _number(3, 313), "'-'", _number(3, 317), "'-'", _number(3, 331), "', CCCD '", _number(12, 99194853094), "'\n'",
    "'USCC 91'", _number(15, 2971215073), _letter(13, "0123456789ABCDEFGHJKLMNPQRTUWXY"), "', mobile 13'", _number(9, 198491317), "', passport no. E'", _number(8, 9227465), "'\n'",
    "'Land lot MK'", _number(2, 19), "' '", _number(5, 104723), "'X, strata lot of the block: TS12 U'", _number(3, 811), "'K PT; MCST No. '", _number(4, 6007), "', CPST plan number CPST'", _number(5, 50021), "'; URA decision no. P'", _number(6, 700001), "'-03B1-Z000, SLA map.\n'",
    "'Trade licence no. CN-'", _number(7, 611957), "', DED CONTACT, DMCC pending. SSN 078-05-1120, ref 219-09-9999, then '", _number(3, 877), "'-'", _number(2, 83), "'-'", _number(4, 9967), "'. nino: ab '", _number(2, 89), "' '", _number(2, 79), "' '", _number(2, 73), "' c\n'",
    "'HKID is '", _letter(5), _letter(11), _number(6, 746777), "'('", _letter(7, "0123456789A"), "'); 個人番号: '", _number(12, 32416190071), "'、郵便番号 '", _number(3, 89), "'-'", _number(4, 5399), "'、주민등록번호: '", _number(6, 900007), "'-'", _number(7, 8675311), "'\n'",
    "'身份证号码'", _number(17, 2971215073), _letter(7, "0123456789X"), "'，手机：13'", _number(9, 198491317), "'، بطاقة الهوية 784-1990-'", _number(7, 99989), "'-3، إقامة 2'", _number(9, 514229), "', CCCD: '", _number(3, 71), "' '", _number(9, 433494437), "'; permanent account number abcp'", _letter(3, "PCHFXQ"), "'1234'", _letter(5), "'; licensed by MAS (CMS'", _number(6, 611951), "').'",
]
TEXT = f"concat({', '.join(_LINES)})"
SQL = f"SELECT c_custkey, {TEXT} AS text FROM customer"

_HEX = "0123456789abcdef"
_uuid = lambda salt: [_number(8, salt), "'-'", _number(4, salt + 6), "'-4'", _number(3, salt + 12), "'-a'", _number(3, salt + 20), "'-'", _number(12, salt + 90)]
#: A sheet of business, device and account records; a part of the numbers is all zero, or has no digit behind its label.
_RECORD_LINES = [
    "'Internal session ID: '", *_uuid(104729), "'_session; bank CIF '", _letter(3), _number(7, 15485863), "'. CIF No. UNKNOWN-'", _letter(7), "'.\n'",
    "'Insurance member ID M-'", _number(6, 611953), "', policy no. POL'", _number(8, 86028121), "', session cookie=ck'", _number(14, 2971215073), "'\n'",
    "'GAID: '", *_uuid(7368787), "', laptop serial number SN-'", _number(8, 94418953), "'\n'",
    "'Companies House number '", _number(8, 433494437), "', VAT number DE'", f"CASE c_custkey % 5 WHEN 0 THEN '000000000' ELSE {_number(9, 413158511)} END", "', PDPC case no. PDPC-'", _number(4, 7919), "'-'", _number(3, 613), "'\n'",
    "'Wallet address 0x'", _number(20, 2971215073), _number(19, 1134903170), _letter(5, _HEX), "', volume of 1,'", _number(3, 7), "',000 units at SGD 2,'", _number(3, 11), "',500 in all, 0,000,000 open.'",
]
RECORD_TEXT = f"concat({', '.join(_RECORD_LINES)})"
RECORD_SQL = f"SELECT c_custkey, {RECORD_TEXT} AS text FROM customer"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, text): one sheet of records a customer."""
    return tables.table(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey", RECORD_TEXT.replace("\n", "\\n") + " AS text")


def _one_of(salt: int, *sentences: str) -> str:
    """One of the sentences, by customer."""
    cases = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(sentences))
    return f"CASE (CAST(c_custkey AS BIGINT) * {salt}) % {len(sentences)} {cases} END"


#: A sheet of markers: field identifiers, events of privacy law, inside information and weak markers, in part negated.
_MARKER_LINES = [
    _letter(3, "STFGM"), _number(7, 746773), _letter(11), "', UEN: '", _number(9, 413158511), "'K, EIN 12-'", _number(7, 6127411), "', Resident ID: '", _number(17, 2971215073), _letter(7, "0123456789X"), "', PAN ABC'", _letter(5, "PCHF"), "'E'", _number(4, 7907), "'F\n'",
    "'Passport K'", _number(7, 611953), "', customer reference: CUS'", _number(6, 86028121), "', MRN: '", _number(8, 179424673), "', TFN '", _number(9, 275604541), "', MAC 0a:1b:'", _number(2, 31), "':'", _number(2, 37), "':'", _number(2, 41), "':ff, DOB 1970-0'", _letter(5, "123456789"), "'-1'", _letter(7, "0123456789"), "'\n'",
    _one_of(7, "The data left under standard contractual clauses", "An adequacy decision is not needed", "He withdrew his consent", "There was excessive data collection", "Keep reasonable security safeguards", "A personal data breach and a breach notification to affected persons"), "'.\n'",
    _one_of(3, "A material adverse effect is feared", "No material adverse change", "It is under embargo", "Nothing to report", "Project Lantern stays confidential"), "'. '",
    _one_of(7, "Unit price: USD 12.50", "Royalty rate of 7.5%", "Volume commitment is 12,000 units", "Rebate rate: 3%"), "', over 1,'", _number(3, 7), "',250 in all.\n'",
    _one_of(11, "Please share with the board", "The analyst call is fixed", "Names on the insider list", "An information barrier stands", "Mainnet launch in May", "A hard fork is near", "The transition plan changes"), "'. '",
    _one_of(13, "Only limited assurance", "A ransomware attack was seen", "The primary endpoint missed", "A capital shortfall looms", "The reserves downgrade follows", "Settlement in principle was reached", "The deal is under consideration", "There is no lateral movement"), "'.'",
]
MARKER_TEXT = f"concat({', '.join(_MARKER_LINES)})"
MARKER_SQL = f"SELECT c_custkey, {MARKER_TEXT} AS text FROM customer"


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, text): one sheet of markers a customer."""
    return tables.table(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey", MARKER_TEXT.replace("\n", "\\n") + " AS text")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, text): one sheet a customer."""
    return tables.table(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey", TEXT.replace("\n", "\\n") + " AS text")
