"""Query 7."""

from . import html_text
from .common import table
from .registry import query


@query("op7_html")
def op7(spark, sf_dir):
    return html_text.digest(table(spark, sf_dir, "pages"))
