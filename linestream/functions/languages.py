"""Language codes: primary subtag, maximal id, display name."""

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from linestream.schema import AUTO

# Fixed values from the public CLDR likely-subtags data: the likely full id of each language on its own.
LANGUAGES = """
    af-Latn-ZA ak-Latn-GH am-Ethi-ET ar-Arab-EG as-Beng-IN az-Latn-AZ ba-Cyrl-RU be-Cyrl-BY bg-Cyrl-BG bm-Latn-ML
    bn-Beng-BD bo-Tibt-CN br-Latn-FR bs-Latn-BA ca-Latn-ES ce-Cyrl-RU ceb-Latn-PH chr-Cher-US ckb-Arab-IQ co-Latn-FR
    cs-Latn-CZ cv-Cyrl-RU cy-Latn-GB da-Latn-DK de-Latn-DE dv-Thaa-MV dz-Tibt-BT ee-Latn-GH el-Grek-GR en-Latn-US
    eo-Latn-001 es-Latn-ES et-Latn-EE eu-Latn-ES fa-Arab-IR ff-Latn-SN fi-Latn-FI fil-Latn-PH fo-Latn-FO fr-Latn-FR
    fy-Latn-NL ga-Latn-IE gd-Latn-GB gl-Latn-ES gn-Latn-PY gsw-Latn-CH gu-Gujr-IN ha-Latn-NG haw-Latn-US he-Hebr-IL
    hi-Deva-IN hr-Latn-HR hsb-Latn-DE ht-Latn-HT hu-Latn-HU hy-Armn-AM ia-Latn-001 id-Latn-ID ig-Latn-NG is-Latn-IS
    it-Latn-IT iu-Cans-CA ja-Jpan-JP jv-Latn-ID ka-Geor-GE kk-Cyrl-KZ kl-Latn-GL km-Khmr-KH kn-Knda-IN ko-Kore-KR
    kok-Deva-IN ku-Latn-TR ky-Cyrl-KG la-Latn-VA lb-Latn-LU lg-Latn-UG ln-Latn-CD lo-Laoo-LA lt-Latn-LT lv-Latn-LV
    mai-Deva-IN mg-Latn-MG mi-Latn-NZ mk-Cyrl-MK ml-Mlym-IN mn-Cyrl-MN mr-Deva-IN ms-Latn-MY mt-Latn-MT my-Mymr-MM
    nb-Latn-NO ne-Deva-NP nl-Latn-NL nn-Latn-NO no-Latn-NO oc-Latn-FR om-Latn-ET or-Orya-IN os-Cyrl-GE pa-Guru-IN
    pl-Latn-PL ps-Arab-AF pt-Latn-BR qu-Latn-PE rm-Latn-CH ro-Latn-RO ru-Cyrl-RU rw-Latn-RW sa-Deva-IN sd-Arab-PK
    se-Latn-NO si-Sinh-LK sk-Latn-SK sl-Latn-SI sm-Latn-WS sn-Latn-ZW so-Latn-SO sq-Latn-AL sr-Cyrl-RS st-Latn-ZA
    su-Latn-ID sv-Latn-SE sw-Latn-TZ ta-Taml-IN te-Telu-IN tg-Cyrl-TJ th-Thai-TH ti-Ethi-ET tk-Latn-TM tn-Latn-ZA
    to-Latn-TO tr-Latn-TR tt-Cyrl-RU ug-Arab-CN uk-Cyrl-UA ur-Arab-PK uz-Latn-UZ vi-Latn-VN wo-Latn-SN xh-Latn-ZA
    yi-Hebr-UA yo-Latn-NG yue-Hant-HK zh-Hans-CN zu-Latn-ZA
"""
# Fixed values from the same data: where the region or the script decides the rest.
DECIDED = {
    "az-Arab": "az-Arab-IR", "az-IQ": "az-Arab-IQ", "az-IR": "az-Arab-IR", "az-RU": "az-Cyrl-RU",
    "ha-CM": "ha-Arab-CM", "ha-SD": "ha-Arab-SD", "kk-Arab": "kk-Arab-CN", "kk-AF": "kk-Arab-AF", "kk-CN": "kk-Arab-CN",
    "kk-IR": "kk-Arab-IR", "kk-MN": "kk-Arab-MN", "ku-Arab": "ku-Arab-IQ", "ku-LB": "ku-Arab-LB", "ky-Arab": "ky-Arab-CN",
    "ky-CN": "ky-Arab-CN", "ky-Latn": "ky-Latn-TR", "ky-TR": "ky-Latn-TR", "mn-CN": "mn-Mong-CN", "mn-Mong": "mn-Mong-CN",
    "ms-CC": "ms-Arab-CC", "pa-Arab": "pa-Arab-PK", "pa-PK": "pa-Arab-PK", "sd-Deva": "sd-Deva-IN",
    "sr-ME": "sr-Latn-ME", "sr-RO": "sr-Latn-RO", "sr-TR": "sr-Latn-TR", "tg-Arab": "tg-Arab-PK", "tg-PK": "tg-Arab-PK",
    "ug-Cyrl": "ug-Cyrl-KZ", "ug-KZ": "ug-Cyrl-KZ", "ug-MN": "ug-Cyrl-MN", "uz-Arab": "uz-Arab-AF", "uz-AF": "uz-Arab-AF",
    "uz-CN": "uz-Cyrl-CN", "yue-CN": "yue-Hans-CN", "yue-Hans": "yue-Hans-CN", "zh-AU": "zh-Hant-AU", "zh-HK": "zh-Hant-HK",
    "zh-Hant": "zh-Hant-TW", "zh-ID": "zh-Hant-ID", "zh-MO": "zh-Hant-MO", "zh-MY": "zh-Hant-MY", "zh-TW": "zh-Hant-TW",
}
LIKELY = {**{x.split("-")[0]: x for x in LANGUAGES.split()}, **DECIDED}


def likely_subtags(path: str) -> dict[str, str]:
    """The public likely-subtags file of CLDR (``likelySubtags.json``), to be given to ``maximal_ids`` in place of ``LIKELY``."""
    with open(path, encoding="utf-8") as f:
        pairs = json.load(f)["supplemental"]["likelySubtags"]
    return {k.replace("_", "-"): v.replace("_", "-") for k, v in pairs.items()}


def _table(d: dict) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in d.items()) + ")")


def _parts(code: Column) -> Column:
    return F.split(F.translate(code, "_", "-"), "-", -1)


def _bare(code: Column) -> Column:
    return ~(code.contains("-") | code.contains("_"))


def primary_subtag(code: Column) -> Column:
    """The language itself: what "same language" compares."""
    return F.lower(F.when(_bare(code), code).otherwise(F.try_element_at(_parts(code), F.lit(1))))


def subtags(code: Column) -> tuple[Column, Column, Column]:
    """Language, script and region of a code, in their usual case; NULL where it has none."""
    parts = _parts(code)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    script = F.initcap(F.try_element_at(F.filter(rest, lambda p: F.length(p) == 4), F.lit(1)))
    region = F.upper(F.try_element_at(F.filter(rest, lambda p: F.length(p).between(2, 3)), F.lit(1)))
    return primary_subtag(code), script, region


def stages(lang: Column, script: Column, region: Column) -> list[Column]:
    """What to look up, one after another; NULL where the code lacks a part."""
    return [
        F.concat(lang, F.lit("-"), script, F.lit("-"), region), F.concat(lang, F.lit("-"), region),
        F.concat(lang, F.lit("-"), script), lang,
    ]


def filled(code: Column, lang: Column, script: Column, region: Column, likely: Column) -> Column:
    """What the code says itself, the rest from its likely id; codes without one stay as written."""
    parts = F.split(likely, "-")
    full = F.concat_ws("-", lang, F.coalesce(script, F.get(parts, 1)), F.coalesce(region, F.get(parts, 2)))
    return F.when(likely.isNotNull(), full).otherwise(code)


def maximal_id(code: Column) -> Column:
    """``language-Script-REGION`` with likely subtags filled in; unknown languages stay as written.

    Language with script and region, with region, with script, alone: the first that the table knows counts.
    A bare language, the common case, is one look into one table.  For a table of any size see ``maximal_ids``.
    """
    lang, script, region = subtags(code)
    table = _table(LIKELY)
    known = F.coalesce(*[F.try_element_at(table, key) for key in stages(lang, script, region)])
    bare = F.try_element_at(_table({k: v for k, v in LIKELY.items() if "-" not in k}), F.lower(code))
    return F.when(_bare(code), F.coalesce(bare, code)).otherwise(filled(code, lang, script, region, known))


def display_name(code: Column, name: Column) -> Column:
    return F.when(code == AUTO, "Auto (detect)").otherwise(F.coalesce(name, code))
