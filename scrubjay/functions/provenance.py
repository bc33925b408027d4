"""Content credentials as column expressions: signer, description, decision ladder, structural scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dispositions, and who a claim may be attributed to (needle, label, whether certificates count).
SCRUB_FREELY, REFUSE, UNRECOGNIZED, NEEDS_CERT, IS_MANIFEST, RESEAL = "scrub_freely", "refuse", "refuse_unrecognized", "refuse_needs_cert", "refuse_is_manifest", "scrub_and_reseal"
REFUSALS = (REFUSE, UNRECOGNIZED, NEEDS_CERT, IS_MANIFEST)
GENERATORS = (("anthropic", "Anthropic", True), ("claude", "Anthropic (Claude)", False))
REASONS = {
    REFUSE: "carries Content Credentials; scrubbing would invalidate them",
    UNRECOGNIZED: "C2PA state could not be established; refusing rather than guessing",
    NEEDS_CERT: "resealing requires a signing identity",
    IS_MANIFEST: "this file is a detached C2PA manifest, not an asset with metadata in it",
}
LABEL_WINDOW = 64

SIGNER = "struct<issuer:string,common_name:string,alg:string,cert_serial:string,claim_generator:string,title:string,validation_state:string>"


def field(signer: Column, name: str) -> Column:
    return signer.getField(name)


def attribution(signer: Column) -> Column:
    generator = F.lower(F.coalesce(field(signer, "claim_generator"), F.lit("")))
    certificate = F.lower(F.concat_ws(" ", field(signer, "issuer"), field(signer, "common_name")))
    out = F.lit(None).cast("string")
    for needle, label, in_certificates in reversed(GENERATORS):
        hit = F.contains(generator, F.lit(needle))
        out = F.when(hit | F.contains(certificate, F.lit(needle)) if in_certificates else hit, label).otherwise(out)
    return out


def filled(value: Column) -> Column:
    return F.when(value != "", value)


def describe_signer(signer: Column) -> Column:
    said = lambda label, value: F.concat(F.lit(label), filled(value))
    name = field(signer, "common_name")
    parts = F.concat_ws(
        ", ",
        said("attributed to ", attribution(signer)),
        said("generator ", field(signer, "claim_generator")),
        said("issuer ", field(signer, "issuer")),
        F.when(~name.eqNullSafe(field(signer, "issuer")), said("signed by ", name)),
        said("alg ", field(signer, "alg")),
        said("validation ", field(signer, "validation_state")),
    )
    return F.when(signer.isNotNull(), F.when(parts == "", "signer not stated").otherwise(parts))


MANIFEST_JSON = (
    "struct<active_manifest:string,validation_state:string,manifests:map<string,struct<title:string,claim_generator_info:array<struct<name:string,version:string>>,"
    "signature_info:struct<issuer:string,common_name:string,alg:string,cert_serial_number:string>>>>"
)


def signer_of(document: Column) -> Column:
    """The active manifest's signer from a manifest store's JSON; null where nothing is stated."""
    parsed = F.from_json(document, MANIFEST_JSON)
    active = F.try_element_at(parsed["manifests"], parsed["active_manifest"])
    first = F.get(active["claim_generator_info"], F.lit(0))
    name = filled(first["name"])
    made_by = F.when(filled(first["version"]).isNotNull(), F.concat(name, F.lit(" "), first["version"])).otherwise(name)
    signature = active["signature_info"]
    values = {"issuer": signature["issuer"], "common_name": signature["common_name"], "alg": signature["alg"], "cert_serial": signature["cert_serial_number"], "claim_generator": made_by, "title": active["title"], "validation_state": filled(parsed["validation_state"])}
    return F.when(F.coalesce(*(filled(v) for v in values.values())).isNotNull(), F.struct(*(v.alias(k) for k, v in values.items()))).otherwise(F.lit(None).cast(SIGNER))


def remote_url(message: Column) -> Column:
    """The address in an error about a remote manifest that was not fetched; '<unparsed>' where it can't be told."""
    url = F.regexp_extract(message, r"(?i)^Remote:.*?from url (\S+)", 1)
    return F.when(url != "", url).when(F.startswith(F.lower(F.trim(message)), F.lit("remote:")), "<unparsed>")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def describe(p: Column) -> Column:
    """A provenance struct (embedded, sidecars, remote_url, unrecognized, is_manifest, manifest_assets, signer) in words."""
    assets = F.array_join(F.transform(p["manifest_assets"], base_name), ", ")
    manifest = F.when(F.size(p["manifest_assets"]) > 0, F.concat(F.lit("detached C2PA manifest for "), assets)).otherwise("detached C2PA manifest, orphaned (no asset of that name beside it)")
    sidecars = F.transform(p["sidecars"], lambda s: F.concat(F.lit("sidecar "), base_name(s)))
    parts = F.concat_ws(
        ", ",
        F.when(p["is_manifest"], manifest),
        F.when(p["embedded"], "embedded manifest"),
        F.when(F.size(sidecars) > 0, F.array_join(sidecars, ", ")),
        F.concat(F.lit("remote manifest at "), filled(p["remote_url"])),
        F.concat(F.lit("unrecognized C2PA state ("), filled(p["unrecognized"]), F.lit(")")),
        describe_signer(p["signer"]),
    )
    return F.when(parts == "", "none").otherwise(parts)


def present(p: Column) -> Column:
    return p["embedded"] | (F.size(p["sidecars"]) > 0) | filled(p["remote_url"]).isNotNull() | filled(p["unrecognized"]).isNotNull() | p["is_manifest"]


def disposition(p: Column, reseal: bool = False, signer_configured: bool = False) -> Column:
    """What may be done to a file. Whatever carries credentials is refused; nothing here strips them."""
    rest = REFUSE if not reseal else RESEAL if signer_configured else NEEDS_CERT
    return F.when(~present(p), SCRUB_FREELY).when(p["is_manifest"], IS_MANIFEST).when(filled(p["unrecognized"]).isNotNull(), UNRECOGNIZED).otherwise(rest)


def refused(kind: Column, error: Column) -> Column:
    return kind.isin(*REFUSALS) | error.isNotNull()


def reason(kind: Column, error: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    return F.coalesce(error, F.try_element_at(table, kind), F.lit(""))


def has_credentials(content: Column) -> Column:
    """Whether bytes hold a plausible box of type jumb with the c2pa label near its start.

    Whole bytes are searched, as Latin-1 text so that positions are bytes. The four bytes before the type must read as a box length that
    fits (0 and 1 are open lengths); where they can't be read the box counts.
    """
    text = F.decode(content, "ISO-8859-1")
    size = F.octet_length(content)
    pieces = F.split(text, "jumb", -1)

    def look(p: Column) -> Column:
        # (bytes up to and with this box type, whether a box counted) over the pieces between types
        def step(acc: Column, piece: Column) -> Column:
            at = acc["at"] + F.char_length(piece)  # offset of the box type that follows this piece
            head = F.substring(content, (at - 3).cast("int"), 4)
            length = F.conv(F.hex(head), 16, 10).cast("long")
            fits = (at < 4) | (length <= 1) | ((length >= 8) & (length <= size - (at - 4)))
            label = F.contains(F.substring(text, (at + 1).cast("int"), LABEL_WINDOW), F.lit("c2pa"))
            return F.struct((at + 4).cast("long").alias("at"), (acc["hit"] | ((at + 4 <= size) & label & fits)).alias("hit"))

        return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("hit")), step, lambda acc: acc["hit"])

    found = F.get(F.transform(F.array(pieces), look), F.lit(0))
    return F.when(F.contains(text, F.lit("jumb")) & F.contains(text, F.lit("c2pa")), found).otherwise(F.lit(False))
