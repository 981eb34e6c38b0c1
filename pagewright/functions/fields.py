"""Small derived fields of inodes, pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the first five bytes of every PDF file, "%PDF-".
PDF_MAGIC = b"%PDF-"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def obfuscate_email(email) -> Column:
    """Every character of the local part becomes '*'; the domain is the second
    '@'-separated part.  ``a@b@c`` -> ``*@b``; NULL stays NULL."""
    e = _c(email)
    local = F.split_part(e, F.lit("@"), F.lit(1))
    domain = F.split_part(e, F.lit("@"), F.lit(2))
    return F.concat(F.regexp_replace(local, r"(?s).", "*"), F.lit("@"), domain)


def is_ready(is_indexed="is_indexed", is_uploaded="is_uploaded", is_ingested="is_ingested",
             is_embedded="is_embedded") -> Column:
    return _c(is_indexed) & _c(is_uploaded) & _c(is_ingested) & _c(is_embedded)


def public_tag(is_public) -> Column:
    """Object tag text: Python's ``str(bool)``, i.e. 'True' / 'False'."""
    return F.initcap(_c(is_public).cast("string"))


def page_doc_id(inode_id, index) -> Column:
    """Search id of a page document: ``{inode_id}_{absolute index}``."""
    return F.concat_ws("_", _c(inode_id).cast("string"), _c(index).cast("string"))


def relative_index(index, from_page) -> Column:
    return _c(index) - _c(from_page)


def readable_by(owner) -> Column:
    return F.array(_c(owner).cast("string"))


def fill_to_page(to_page, page_count) -> Column:
    """Keep ``to_page`` unless it is NULL or 0; then use the page count."""
    return F.coalesce(F.nullif(_c(to_page), F.lit(0)), _c(page_count).cast("int"))


def in_page_range(index, from_page, to_page) -> Column:
    """``from_page <= index < to_page``; a NULL bound selects nothing."""
    return (_c(index) >= _c(from_page)) & (_c(index) < _c(to_page))


def needs_embedding(embedding) -> Column:
    return _c(embedding).isNull()


def path_changed(new, old) -> Column:
    """Python ``new != old`` with None: NULL-safe inequality."""
    return ~_c(new).eqNullSafe(_c(old))


def is_file(type_col) -> Column:
    return _c(type_col) == "file"


def notifiable(ready, error) -> Column:
    """Notify when the inode is ready or carries an error."""
    return F.coalesce(_c(ready), F.lit(False)) | (F.coalesce(_c(error), F.lit("")) != "")


def is_pdf(content) -> Column:
    """Content sniff: the bytes start with ``%PDF-``."""
    c = _c(content).cast("binary")
    return F.substring(c, 1, len(PDF_MAGIC)) == F.lit(bytearray(PDF_MAGIC))
