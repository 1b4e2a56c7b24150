"""Text keys: subdivisions, counties, owners, mailing addresses, parcel ids, remarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that stand for no name.
NO_SUBDIVISION = ["NONE", "OTHER", "NA", "TBD", "UNKNOWN", "NULL", ""]
NO_OWNER = ["UNKNOWN", "OWNER UNKNOWN", "VARIOUS", "MULTIPLE", "CEMETERY", "TENANTS", "TENANT", "TENANTS IN COMMON", "JOINT TENANTS", "OCCUPANT", "RESIDENT", "PROPERTY OWNER", "CURRENT OWNER"]
NO_MAILBOX = ["COMMON AREA", "COMMON AREAS", "SAME", "SAME AS ABOVE", "UNKNOWN"]
SUBDIVISION_PREFIXES = ["VILLAS AT ", "ESTATES AT ", "VILLAGES AT ", "VILLAGE AT ", "RESERVE AT ", "ENCLAVE AT ", "GARDENS AT ", "HEIGHTS AT "]
# Patterns of owners' names, upper case.
ROLES = r"\b(TRUSTEES?|TRS|TR|TTE|TTEE|ETUX|ETUS|ET\s*UX|ETAL|ET\s*AL|LIFE\s+ESTATE|LIFE\s+TENANT|JR|SR|II+|IV|V|REVOCABLE|IRREVOCABLE|LIVING|FAMILY|DEC[D]?|DECEASED)\b"
ENTITY = r"\b(LLC|INC\b|CORP(?:ORATION)?|COMPANY|CO\b|LP\b|LLP\b|LTD|LIMITED|PARTNERSHIP|HOLDINGS|PROPERTIES|MANAGEMENT|MGMT|REALTY|INVEST|CAPITAL|GROUP\b|VENTURES|ASSOCIATES|DEVELOPMENT|BUILDERS|CONSTRUCTION|BUILDING|CHURCH|MINISTRIES|TEMPLE|MOSQUE|SYNAGOGUE|FOUNDATION|FOUNDATIONS|CEMETERY|HOA\b|HOMEOWNERS|COUNTY|TOWN|CITY|STATE|COMMONWEALTH|UNITED\s+STATES|U\s?S\s?A|FEDERAL|COMMISSION|AUTHORITY|DEPARTMENT|AGENCY|BOARD\s+OF|SCHOOL|SCHOOLS|BANK\b|CREDIT\s+UNION|VPI\b|VIRGINIA\s+TECH|UNIVERSITY|COLLEGE)\b"
ESTATE = r"\b(ESTATE\s+OF\s+|HEIRS\s+OF\s+|.+\s+ESTATE\b|.+\s+HEIRS\b)"
ENTITY_SUFFIX = r"\b(LLC|INC|CORP(?:ORATION)?|LP|LLP|LTD|LIMITED)\b"
GOVERNMENT = r"COMMONWEALTH OF|\bUSA\b|UNITED STATES|U\.?\s?S\.?\s+GOVERNMENT|\bSTATE OF\b|\bCOUNTY OF\b|COUNTY BOARD|\bTOWN OF\b|\bCITY OF\b|\bMONTGOMERY COUNTY\b|DEPT OF|DEPARTMENT OF|\bVA DEPT\b|BOARD OF SUPERVISORS|SCHOOL BOARD|HOUSING AUTHORITY|HOUSING PARTNERS|\bAUTHORITY\b|VIRGINIA POLYTECHNIC|VIRGINIA TECH|\bVPI\b|\bUNIVERSITY\b|\bHOA\b|HOME\s*OWNERS?|\bCONDOMINIUMS?\b|\bCONDO\s+ASSOC|\bSUBDIVISION\b|VILLAGE\s+AT\b|VILLAS\s+AT\b|COMMONS\s+AT\b|\bCEMETERY\b|\bCEMETARY\b|\bHILLEL\b|\bFRATERNITY\b|\bSORORITY\b|ALUMNI\s+ASSOC|\bFELLOWSHIP\b|HABITAT\s+FOR\b|\bSYNAGOGUE\b|\bTEMPLE\s+OF\b|\bMINISTRIES\b|\bMINISTRY\b"
BUSINESS = r"\bLLC\b|\bL\.?L\.?C\.?\b|\bINC\b|\bCORP\b|\bCORPORATION\b|\bTRUST\b|\bTRUSTEE|\bTR\s*$|FAMILY\s+TR\b|\bLP\b|\bLLP\b|\bLTD\b|\bLIMITED\b|\bPARTNERSHIP\b|\bHOLDINGS?\b|\bPROPERTIES\b|\bASSOCIATES\b|\bGROUP\b|\bINVESTMENTS?\b|\bCHURCH\b|\bFOUNDATION\b|\bREAL ESTATE\b|\bRENTALS?\b|\bDEVELOPMENT\b|\bDEVELOPERS\b|\bHOMES\b|\bCONSTRUCTION\b|\bCAPITAL\b|\bVENTURES\b"
LISTED_ENTITY = r"\b(LLC|L\.L\.C\.|INC|CORP|CORPORATION|LP|LLP|HOLDINGS|PROPERTIES|REALTY|INVESTMENTS|CAPITAL|VENTURES|ASSOCIATES|DEVELOPMENT|BUILDERS|CONSTRUCTION)\b"
PROBATE = r"(?i)\b(ESTATE\s+OF|ESTATE\s+\b|HEIRS?\s+OF|TRUSTEE|LIFE\s+ESTATE|LIFE\s+TENANT|DEC['’]?D|DECEASED|REVOCABLE\s+TRUST|LIVING\s+TRUST|FAMILY\s+TRUST)\b"
# Postal abbreviations.
SUFFIXES = {
    "STREET": "ST", "AVENUE": "AVE", "DRIVE": "DR", "ROAD": "RD", "LANE": "LN", "COURT": "CT", "BOULEVARD": "BLVD", "HIGHWAY": "HWY", "CIRCLE": "CIR", "PLACE": "PL", "PARKWAY": "PKWY", "TERRACE": "TER",
    "TRAIL": "TRL", "EXPRESSWAY": "EXPY", "SQUARE": "SQ", "MOUNT": "MT", "POBOX": "PO BOX", "APARTMENT": "APT", "SUITE": "STE", "NUMBER": "",
}
# What remarks say about condition, with weights; the score starts at 2.5.
CONDITION = {
    "renovated": (r"\b(fully\s+renovated|completely\s+renovated|renovated\s+throughout|just\s+renovated|recent(ly)?\s+renovated)\b", 1.5),
    "renovation_partial": (r"\b(renovat(ed|ion))\b", 0.7),
    "turnkey": (r"\b(turn[-\s]?key|move[-\s]?in\s+ready)\b", 1.0),
    "new_kitchen": (r"\b(new\s+kitchen|brand[-\s]new\s+kitchen|fully\s+updated\s+kitchen|kitchen\s+remodel|remodeled\s+kitchen)\b", 0.8),
    "new_bath": (r"\b(new\s+bath|remodeled\s+bath|bath(room)?\s+remodel|new(ly)?\s+updated\s+bath)\b", 0.6),
    "new_roof": (r"\b(new\s+roof|roof\s+replaced|recent(ly)?\s+replaced\s+roof)\b", 0.6),
    "new_hvac": (r"\b(new\s+(hvac|furnace|heat\s+pump|a\.?c\.?)|hvac\s+replaced)\b", 0.4),
    "new_floors": (r"\b(new\s+floor(ing|s)|hardwood(\s+floors)?\s+throughout|new\s+lvp|new\s+vinyl\s+plank)\b", 0.4),
    "freshly_painted": (r"\b(fresh(ly)?\s+paint(ed)?|new\s+paint(\s+throughout)?)\b", 0.3),
    "luxury": (r"\b(luxury|designer|custom\s+built|architect[-\s]designed|estate\s+home)\b", 0.5),
    "upgrade": (r"\b(upgrade(d|s)|update(d|s))\b", 0.3),
    "granite_quartz": (r"\b(granite|quartz)\s+counter(top)?s?\b", 0.3),
    "stainless": (r"\bstainless(\s+steel)?\s+(appliance|appl)\b", 0.2),
    "well_maintained": (r"\b(well[-\s]maintained|meticulous(ly\s+maintained)?|pride\s+of\s+ownership|lovingly\s+cared)\b", 0.5),
    "smart_home": (r"\b(smart\s+home|nest|ring|smart\s+thermostat)\b", 0.2),
    "energy_efficient": (r"\b(energy[-\s]efficient|solar\s+panels?|geothermal)\b", 0.3),
    "as_is": (r"\b(sold\s+as[-\s]is|as[-\s]is\s+condition|as\s+is(\s+where\s+is)?)\b", -2.0),
    "needs_tlc": (r"\b(needs?\s+tlc|some\s+tlc|tender\s+loving\s+care)\b", -1.5),
    "fixer": (r"\b(fixer[-\s]upper|fixer\s+special|investor\s+special|handyman\s+special|diy[-\s]special)\b", -1.8),
    "needs_work": (r"\b(needs\s+work|need(s|ed)\s+repair|some\s+repair(s)?|requires\s+repairs?)\b", -1.2),
    "estate_sale": (r"\b(estate\s+sale|estate\s+of|heirs?\s+selling|probate\s+sale)\b", -0.5),
    "foreclosure": (r"\b(foreclosure|foreclosed|reo\b|bank[-\s]owned|short\s+sale)\b", -1.0),
    "dated": (r"\b(dated|original\s+(kitchen|bath|condition)|bring\s+your\s+vision|tons?\s+of\s+potential)\b", -0.5),
    "deferred_maint": (r"\b(deferred\s+maintenance|cosmetic\s+repair(s)?\s+needed)\b", -0.8),
    "priced_to_sell": (r"\b(priced\s+to\s+sell|priced\s+(below|under)\s+(market|appraisal|tax))\b", -0.3),
    "cash_only": (r"\b(cash\s+only|cash\s+offer(s)?\s+only)\b", -1.0),
}
MANUFACTURED = r"(?i)\b(manufactured(\s+home)?|mobile\s+home|single[-\s]?wide|double[-\s]?wide|triple[-\s]?wide|modular(\s+home)?|hud\s+(home|tag))\b"
DISTRESSED = r"(?i)\b(sold\s+as[-\s]is|as[-\s]is\s+condition|fixer[-\s]upper|investor\s+special|handyman\s+special|foreclosure|reo\b|bank[-\s]owned|short\s+sale|cash\s+only|estate\s+sale|probate\s+sale)\b"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def subdivision_key(c: Column) -> Column:
    """The same name however it is written; null for placeholders."""
    s = squeeze(F.regexp_replace(F.upper(c), r"[‘’'`\".,\-_/]", ""))
    s = F.regexp_replace(s, "^THE ", "")
    for prefix in SUBDIVISION_PREFIXES:
        s = F.regexp_replace(s, "^" + prefix, "")
    s = F.trim(s)
    return F.when(~s.isin(NO_SUBDIVISION), s)


def county_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.upper(F.trim(c)), r"\b(COUNTY|CO\.?|CITY OF)\b", ""))


def owner_name(c: Column) -> Column:
    """Upper case, & as AND, without a care-of prefix and punctuation; null where nobody is named."""
    s = F.regexp_replace(F.replace(F.upper(c), F.lit("&"), F.lit(" AND ")), r"^\s*C\s*/\s*O\s+", "")
    s = squeeze(F.regexp_replace(s, r"[^A-Z0-9\s\-]", " "))
    return F.when((F.length(s) >= 3) & ~s.isin(NO_OWNER), s)


def owner_type(name: Column) -> Column:
    """entity, estate, trust or person of a name made by :func:`owner_name`."""
    return F.when(name.rlike(ENTITY), "entity").when(name.rlike(ESTATE), "estate").when(name.rlike(r"\bTRUST\b"), "trust").when(name.isNotNull(), "person")


def owner_key(name: Column) -> Column:
    """One key for an owner's variants: EST:, ENT:, TRU: or PER: and the name without roles."""
    kind = owner_type(name)
    clean = F.regexp_replace(squeeze(F.regexp_replace(name, ROLES, "")), r"^[ \-]+|[ \-]+$", "")
    estate = F.coalesce(*(F.nullif(F.regexp_extract(clean, p, 1), F.lit("")) for p in (r"^ESTATE\s+OF\s+(.+)$", r"^HEIRS\s+OF\s+(.+)$", r"^(.+)\s+(?:ESTATE|HEIRS)$")), clean)
    entity, trust = squeeze(F.regexp_replace(clean, ENTITY_SUFFIX, "")), squeeze(F.regexp_replace(clean, r"\bTRUST\b", ""))
    words = F.filter(F.split(clean, " "), lambda w: F.length(w) > 1)
    person = F.when(F.size(words) >= 2, F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))).otherwise(F.nullif(clean, F.lit("")))
    long = lambda p, s: F.when(F.length(s) >= 2, F.concat(F.lit(p), s))
    return F.when(kind == "estate", F.concat(F.lit("EST:"), F.split(F.trim(estate), " ")[0])).when(kind == "entity", long("ENT:", entity)).when(kind == "trust", long("TRU:", trust)).otherwise(F.concat(F.lit("PER:"), person))


def owner_class(c: Column) -> Column:
    """person, entity, govt_or_institution or unknown, as the parcel reports use it."""
    u = F.upper(c)
    return F.when(F.coalesce(u, F.lit("")) == "", "unknown").when(u.rlike(GOVERNMENT), "govt_or_institution").when(u.rlike(BUSINESS), "entity").otherwise("person")


def listed_owner_class(upper: Column) -> Column:
    """entity, trust_or_family or person, as the listing reports use it."""
    return F.when(upper.rlike(LISTED_ENTITY), "entity").when(upper.rlike(r"\b(TRUST|FAMILY|LIVING)\b"), "trust_or_family").otherwise("person")


def address_key(c: Column) -> Column:
    return F.coalesce(squeeze(F.upper(c)), F.lit(""))


def mail_key(c: Column) -> Column:
    """A mailbox however it is written: upper case, no punctuation, postal abbreviations, no ZIP+4."""
    words = F.split(squeeze(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[.,#]", " ")), " ")
    table = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    short = F.filter(F.transform(words, lambda w: F.coalesce(table[w], w)), lambda w: w != "")
    return F.regexp_replace(F.array_join(short, " "), r"-\d{4}\b", "")


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def usable_parcel_id(c: Column) -> Column:
    """Whether an id names a parcel: four letters or digits at least, not one character over and over, no placeholder."""
    s = alnum(c)
    return (F.length(s) >= 4) & (F.size(F.array_distinct(F.filter(F.split(s, ""), lambda x: x != ""))) > 1) & ~s.isin("UNKNOWN", "NONE", "NULL", "TBD", "PENDING")


def parcel_id_variants(c: Column) -> Column:
    """Ways to write an id, best first: as it is, letters and digits only, padded to 12 and stripped of leading zeros."""
    s = F.trim(c)
    return F.array_distinct(F.filter(F.array(s, alnum(s), F.lpad(alnum(s), 12, "0"), F.regexp_replace(alnum(s), "^0+", "")), lambda x: x.isNotNull() & (x != "")))


def with_condition(rows: DataFrame, remarks: str) -> DataFrame:
    """``rows`` with condition_score (0 to 5), condition_flags, is_manufactured, is_distressed, condition_label of their remarks.

    Each pattern is tried once a row: the hits are a column of their own, the score another, which later steps only read.
    """
    text = F.col(remarks)
    rows = rows.withColumns({"_hits": F.array(*(text.rlike("(?i)" + p) for p, _ in CONDITION.values())), "is_manufactured": F.coalesce(text.rlike(MANUFACTURED), F.lit(False)), "is_distressed": F.coalesce(text.rlike(DISTRESSED), F.lit(False))})
    total = sum((F.when(F.get("_hits", F.lit(i)), w).otherwise(0.0) for i, (_, w) in enumerate(CONDITION.values())), F.lit(2.5))
    said = F.length(F.coalesce(text, F.lit(""))) > 0
    flags = F.array_join(F.array_compact(F.array(*(F.when(F.get("_hits", F.lit(i)), F.lit(k)) for i, k in enumerate(CONDITION)))), ";")
    rows = rows.withColumns({"condition_score": F.when(said, F.round(F.least(F.lit(5.0), F.greatest(F.lit(0.0), total)), 2)), "condition_flags": F.coalesce(flags, F.lit(""))})
    score = F.col("condition_score")
    label = F.when(score.isNull(), "(no remarks)").when(score >= 4.5, "fully renovated").when(score >= 3.5, "well-updated").when(score >= 2.5, "average / well-maintained").when(score >= 1.5, "dated / needs cosmetic").otherwise("distressed / needs work")
    return rows.withColumn("condition_label", label).drop("_hits")
