"""Citation ids: three grammars tried in order, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammars. Groups are numbered in the order of the fields below.
_N = r"\d+[a-z]*"
STATUTE = (
    rf"^(SR \d+(?:\.\d+)*|\S.*?)(?: (SchlT))? (?:(?:Art\. ({_N}|[IVXLC]+) )?§ ?({_N})|Art\. ({_N}))"
    rf"(?: Abs\. ({_N}))?(?: (?:S\.|Satz) (\d+))?(?: Nr\. ({_N}))?(?: lit\. ([a-z]{{1,2}}))?$"
)
DECISION = (
    r"^(BGH|BVerfG|BVerwG|BFH|BAG|BSG|BPatG|OGH|VfGH|VwGH|BGer|BVGer|EuGH|EuG|[A-Z][A-Za-z]*G|[A-Z][A-Za-z]*GH) "
    r"((?U)[\w\s/.\-()]+?)(?: (?:Rn\.|Rz\.) (\d+)| E\. (\d+(?:\.\d+)*))?$"
)
PAPER = r"^(BT-Drs\.|BR-Drs\.|BT-PlPr\.|BR-PlPr\.) (\d+/\d+)(?: S\. (\d+))?$"
STATUTE_FIELDS = ("code", "part", "within", "paragraph", "article", "absatz", "satz", "nummer", "litera")
DECISION_FIELDS = ("court", "docket", "randnummer", "erwaegung")
PAPER_FIELDS = ("series", "number", "page")


def parse(citation: Column) -> Column:
    """A struct: kind (null outside the grammars) and the fields of all kinds, null where absent."""
    is_s, is_d, is_p = (F.coalesce(citation.rlike(g), F.lit(False)) for g in (STATUTE, DECISION, PAPER))
    kind = F.when(is_s, "statute").when(is_d, "decision").when(is_p, "parliament")
    take = lambda ok, g, k: F.when(ok, F.nullif(F.trim(F.regexp_extract(citation, g, k)), F.lit("")))
    s = {f: take(is_s, STATUTE, k + 1) for k, f in enumerate(STATUTE_FIELDS)}
    s["article"] = F.coalesce(s.pop("within"), s["article"])
    d = {f: take(~is_s & is_d, DECISION, k + 1) for k, f in enumerate(DECISION_FIELDS)}
    p = {f: take(~is_s & ~is_d & is_p, PAPER, k + 1) for k, f in enumerate(PAPER_FIELDS)}
    return F.struct(kind.alias("kind"), *(c.alias(f) for f, c in (s | d | p).items()))


def act_of(citation: Column) -> Column:
    """The act's code with its part; what stands before the § or Art. outside the grammars; the whole id for other kinds."""
    p = parse(citation)
    within = F.concat(p["code"], F.coalesce(F.concat(F.lit(" "), p["part"]), F.lit("")))
    return F.when(p["kind"] == "statute", within).when(p["kind"].isNotNull(), citation).otherwise(F.element_at(F.split(citation, r" ?§| Art\. "), 1))
