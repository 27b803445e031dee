"""Column functions on file names, content types, headers and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and content types that the platform knows.
CONTENT_TYPES = {
    ".pdf": "application/pdf",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".rtf": "application/rtf",
    ".epub": "application/epub+zip",
    ".csv": "text/csv",
    ".json": "application/json",
    ".xml": "application/xml",
    ".yaml": "application/yaml",
    ".yml": "application/yaml",
    ".html": "text/html",
    ".htm": "text/html",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".odt": "application/vnd.oasis.opendocument.text",
    ".ods": "application/vnd.oasis.opendocument.spreadsheet",
    ".odp": "application/vnd.oasis.opendocument.presentation",
    ".eml": "message/rfc822",
    ".msg": "application/vnd.ms-outlook",
    ".zip": "application/zip",
    ".rar": "application/vnd.rar",
    ".7z": "application/x-7z-compressed",
    ".tgz": "application/gzip",
    ".tar.gz": "application/gzip",
    ".gz": "application/gzip",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".bmp": "image/bmp",
}
ARCHIVE_EXTENSIONS = [".zip", ".rar", ".7z", ".tar.gz", ".tgz", ".gz"]
ARCHIVE_TYPES = [
    "application/zip", "application/x-zip-compressed", "application/vnd.rar", "application/x-rar-compressed",
    "application/x-7z-compressed", "application/gzip", "application/x-gzip", "application/x-tar",
]
MAIL_EXTENSIONS = [".eml", ".msg"]
MAIL_TYPES = ["message/rfc822", "application/vnd.ms-outlook"]
SUPPORTED_EXTENSIONS = [e for e in CONTENT_TYPES if e != ".gz"]
ALLOWED_EXTENSIONS = SUPPORTED_EXTENSIONS
ALLOWED_TYPES = sorted(
    {t for e, t in CONTENT_TYPES.items()}
    | {"text/rtf", "text/xml", "application/x-yaml", "text/yaml", "text/x-yaml", "application/x-zip-compressed", "application/x-rar-compressed", "application/x-gzip", "application/x-tar"}
)
ZIP_BACKED = [".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp", ".epub"]
#: Further content types that an extension may have, besides its own.
ALSO_TYPES = {
    ".md": ["text/plain"],
    ".rtf": ["text/rtf", "text/plain"],
    ".csv": ["text/plain"],
    ".json": ["text/plain"],
    ".xml": ["text/xml", "text/plain"],
    ".yaml": ["application/x-yaml", "text/yaml", "text/x-yaml", "text/plain"],
    ".yml": ["application/x-yaml", "text/yaml", "text/x-yaml", "text/plain"],
    ".html": ["text/plain"],
    ".htm": ["text/plain"],
    ".eml": ["text/plain"],
    ".zip": ["application/x-zip-compressed"],
    ".rar": ["application/x-rar-compressed"],
    ".tgz": ["application/x-gzip"],
    ".tar.gz": ["application/x-gzip"],
    **{e: ["application/zip"] for e in ZIP_BACKED},
}

#: Extractors in the order in which they are tried: content types, extensions.
ROUTES: list[tuple[str, list[str], list[str]]] = [
    ("pdf", ["application/pdf"], [".pdf"]),
    ("image", ["image/*"], [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp"]),
    ("word", [CONTENT_TYPES[".docx"]], [".docx"]),
    ("sheet", [CONTENT_TYPES[".xlsx"]], [".xlsx"]),
    ("slides", [CONTENT_TYPES[".pptx"]], [".pptx"]),
    ("opendoc", [CONTENT_TYPES[e] for e in (".odt", ".ods", ".odp")], [".odt", ".ods", ".odp"]),
    ("email", MAIL_TYPES, MAIL_EXTENSIONS),
    ("rtf", ["application/rtf", "text/rtf"], [".rtf"]),
    ("epub", ["application/epub+zip"], [".epub"]),
    ("yaml", ["application/yaml", "application/x-yaml", "text/yaml", "text/x-yaml"], [".yaml", ".yml"]),
    ("html", ["text/html"], [".html", ".htm"]),
    ("text", ["text/plain", "text/csv", "text/markdown", "application/json", "application/xml", "text/xml"], [".txt", ".md", ".csv", ".json", ".xml"]),
    ("archive", ARCHIVE_TYPES, ARCHIVE_EXTENSIONS),
]

#: Hex prefixes of the first bytes, in order.
MAGIC = [
    ("^377ABCAF271C", "application/x-7z-compressed"),
    ("^526172211A070[01]", "application/vnd.rar"),
    ("^504B0[357]0[468]", "application/zip"),
    ("^D0CF11E0A1B11AE1", "application/vnd.ms-outlook"),
    ("^1F8B", "application/gzip"),
    ("^255044462D", "application/pdf"),
    ("^89504E470D0A1A0A", "image/png"),
    ("^FFD8FF", "image/jpeg"),
    ("^(?:49492A00|4D4D002A)", "image/tiff"),
    ("^424D", "image/bmp"),
]


def plain_extension(name: Column) -> Column:
    """From the last dot of the last path part, lower-cased; '' if nothing follows it."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^./\\]+)$", 1))


def effective_extension(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".tar.gz"), ".tar.gz").otherwise(plain_extension(name))


def declared_type(t: Column) -> Column:
    """Before any ';', trimmed, lower-cased."""
    return F.lower(F.trim(F.split_part(F.coalesce(t, F.lit("")), F.lit(";"), F.lit(1))))


def _lookup(ext: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), ext)


def guess_content_type(name: Column, declared: Column) -> Column:
    d = declared_type(declared)
    return F.when((d != "") & (d != "application/octet-stream"), d).otherwise(F.coalesce(_lookup(effective_extension(name), CONTENT_TYPES), F.lit("application/octet-stream")))


def container_kind(name: Column, content_type: Column) -> Column:
    """'archive', 'email' or 'none'."""
    ext, t = effective_extension(name), F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(ext.isin(ARCHIVE_EXTENSIONS) | t.isin(ARCHIVE_TYPES), "archive").when(ext.isin(MAIL_EXTENSIONS) | t.isin(MAIL_TYPES), "email").otherwise("none")


def supported_for_pipeline(name: Column, content_type: Column) -> Column:
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return effective_extension(name).isin(SUPPORTED_EXTENSIONS) | t.startswith("text/") | t.isin(sorted(set(CONTENT_TYPES.values())))


def route_extractor(name: Column, content_type: Column) -> Column:
    """The first extractor that takes the file."""
    ext, t = effective_extension(name), F.lower(F.coalesce(content_type, F.lit("")))
    out = None
    for label, types, extensions in ROUTES:
        hit = ext.isin(extensions) | (t.startswith("image/") if types == ["image/*"] else t.isin(types))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("unsupported")


def looks_like_text(header: Column) -> Column:
    """No NUL, and printable bytes are 85 % at least (0x80 to 0xC1 do not count); empty is no text."""
    h = F.hex(F.substring(header, 1, 512))
    n = (F.length(h) / 2).cast("int")
    # one mark a byte: pairs of hex digits of unprintable bytes are dropped
    printable = F.length(F.regexp_replace(F.regexp_replace(h, "(..)", "$1 "), "(?:0[0-8BCEF]|1.|7F|[89AB].|C[01]) ", "")) / 3
    return (n > 0) & ~F.regexp_replace(h, "(..)", "$1 ").rlike(r"(?:^| )00 ") & (printable >= F.floor(n * 0.85))


def sniff_content_type(header: Column) -> Column:
    """Content type by the first bytes, else text/plain for printable ones, else null."""
    h = F.hex(F.substring(header, 1, 8))
    out = None
    for pattern, t in MAGIC:
        out = F.when(h.rlike(pattern), t) if out is None else out.when(h.rlike(pattern), t)
    return out.when(looks_like_text(header), "text/plain")


def compatible_types(declared: Column, detected: Column) -> Column:
    pair = F.concat_ws(">", declared, detected)
    return (
        (declared == detected)
        | (declared == "application/octet-stream")
        | (declared.startswith("text/") & detected.startswith("text/"))
        | pair.isin("application/xml>text/xml", "text/xml>application/xml", "image/jpg>image/jpeg", "image/jpeg>image/jpg")
        | ((detected == "application/zip") & (F.contains(declared, F.lit("openxmlformats-officedocument")) | F.contains(declared, F.lit("oasis.opendocument")) | (declared == "application/epub+zip")))
    )


def url_host(url: Column) -> Column:
    """The host, lower-cased; that of an IPv6 address stands in its brackets."""
    return F.lower(F.regexp_extract(url, r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1))


_NUMBER = "(?:0x[0-9a-f]+|[0-9]+)"


def _number(part: Column) -> Column:
    """A part of a numeric address: decimal, octal after 0, hexadecimal after 0x."""
    hexa, octal = F.conv(F.substring(part, 3, 16), 16, 10), F.conv(part, 8, 10)
    return F.when(part.startswith("0x"), hexa).when(part.rlike("^0[0-7]+$"), octal).otherwise(part).try_cast("long")


def _private_value(v: Column) -> Column:
    """Whether a 32-bit address is in a private or reserved range."""
    a, ab = F.shiftright(v, 24), F.shiftright(v, 16)
    return a.isin(0, 10, 127) | ab.between(0xAC10, 0xAC1F) | (ab == 0xC0A8) | (ab == 0xA9FE)


def _private_v4(host: Column) -> Column:
    """Private addresses in all their numeric spellings: one to four numbers, of which the last fills what is left.
    Four decimal numbers count as such too when they begin with 0."""
    parts = F.split(host, r"\.")
    n = F.transform(parts, _number)
    k, at = F.size(parts), lambda i: F.try_element_at(n, F.lit(i))
    high = lambda i, bits: F.shiftleft(at(i), bits)
    value = F.when(k == 1, at(1)).when(k == 2, high(1, 24) + at(2)).when(k == 3, high(1, 24) + high(2, 16) + at(3)).otherwise(high(1, 24) + high(2, 16) + high(3, 8) + at(4))
    d = F.transform(parts, lambda p: p.try_cast("int"))
    plain = F.shiftleft(F.try_element_at(d, F.lit(1)).cast("long"), 24) + F.shiftleft(F.try_element_at(d, F.lit(2)).cast("long"), 16)
    quad = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & _private_value(plain)
    return F.coalesce(host.rlike(rf"^{_NUMBER}(\.{_NUMBER}){{0,3}}$") & _private_value(value), F.lit(False)) | F.coalesce(quad, F.lit(False))


def _private_v6(host: Column) -> Column:
    """Loopback, link-local fe80::/10, site-local fec0::/10, unique local fc00::/7, and IPv4
    addresses in IPv6 form (dotted or not) that are private."""
    inside = F.regexp_extract(host, r"^\[([^\]%]*)(?:%[^\]]*)?\]$", 1)
    mapped = F.regexp_extract(inside, r"^(?:0{0,4}:)+ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    words = r"^(?:0{0,4}:)+ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    value = F.shiftleft(F.conv(F.regexp_extract(inside, words, 1), 16, 10).try_cast("long"), 16) + F.conv(F.regexp_extract(inside, words, 2), 16, 10).try_cast("long")
    hexed = F.coalesce(inside.rlike(words) & _private_value(value), F.lit(False))
    return inside.rlike("^[0:]*:0{0,3}1$") | inside.rlike("^fe[89a-f][0-9a-f]:") | inside.rlike("^f[cd][0-9a-f]{2}:") | hexed | _private_v4(mapped)


def url_gate(url: Column, allow_http: bool = False) -> Column:
    """'ok', or why an address is refused. Names are not resolved; a bracketed host that is no IPv6
    address is refused like one that is private."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(url_host(url), r"(?<=[^.])\.$", "")  # a name may end with the root's dot
    bracket = host.startswith("[")
    strange = bracket & ~host.rlike(r"^\[(?=[^\]]*:)[0-9a-f:.]*(?:%[^\]]*)?\]$")
    return (
        F.when(F.coalesce(scheme, F.lit("")).isin("http", "https") == F.lit(False), "not an absolute http address")
        .when((host == "") | strange, "not an absolute http address")
        .when((scheme == "http") & F.lit(not allow_http), "https is required")
        .when((host == "localhost") | host.endswith(".local") | host.endswith(".internal"), "local host")
        .when(_private_v4(host) | (bracket & _private_v6(host)), "private address")
        .otherwise("ok")
    )


def url_document_name(url: Column) -> Column:
    """Host and path."""
    return F.concat(url_host(url), F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1))
