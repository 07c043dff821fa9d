"""The main text of web pages: flat text blocks, judged by a decision tree.

A page is cut at block-level tags into a flat list of text blocks. Each has a word
count and a link density (share of its words inside links), its neighbours' ones, and
marks of its place: inside an element of page furniture (menus, footers, forms) or reader comments,
under another name of furniture (adverts and the like), and inside an article, beside one, or on a page
without. A small decision tree, trained on the labelled table below, tells main text from the rest.

Cases: null and empty pages have an empty text, as have pages whose blocks are all
rejected. Unclosed comments, scripts, styles and other elements of raw text reach to the
end of the page; unclosed or crossed elements end with the element around them. An
element without text of the page (a button, a drawing) that nothing further on closes
ends at the next block. Rows may repeat. Other columns
stay; result columns replace input columns of the same name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from shelfwise.llm.pretokens import portions
from shelfwise.llm.workers import ship_code, slices

#: Fixed values of HTML: elements whose content is never text of the page (raw text, in which there are no tags; others, of
#: which drawings may close themselves), those that do not break a block, and those that are never closed.
_RAW = frozenset("script style noscript title textarea iframe".split())
_UNSEEN = frozenset("template select option button object svg math canvas audio video".split())
_DRAWN = frozenset(("svg", "math"))
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
                    "strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and names (of class, id and role) of page furniture, and words that may stand beside such a name in one.
_FURNITURE = frozenset("nav footer aside form menu dialog".split())
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
                   "disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
                   "promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_AFFIXES = frozenset("area bar block bottom box btn button buttons col container content count desktop dialog fixed form global google group icon icons id "
                     "inline inner item items js left link links list main message mobile module nested outer overlay page panel post posts primary "
                     "article articles entry region right row secondary section site slot sticky story stories text thread title top unit wrap wrapper".split())
#: Names of what readers write: the first say so alone, the second beside one of the third.
_READ = frozenset("comment comments disqus replies respond".split())
_SAID = frozenset("comment comments discussion discussions feedback letters opinion opinions posts remarks responses review reviews voices".split())
_READERS = frozenset("customer customers guest guests member members reader readers user users visitor visitors".split())
_ARTICLE = frozenset(("article", "main"))
#: Elements of an article whose id is an anchor, made from a title.
_ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p section".split())

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[^\W_]")

#: Of each example block: words, link density, words and link density of the block before, the same of the block behind (0 where there
#: is none), inside an element of furniture or reader comments, under another name of furniture, place (1 in an article, 0 beside one, 0.5 on a
#: page without); and whether it is main text.
EXAMPLES = (
    # words  link   before      behind      elem. name  place  main
    # Menus, link lists and teasers, with names and without.
    (90,      0.90,  3,   1.00,  2,   1.00,  0,    0,    0,     0),
    (120,     0.80,  60,  0.00,  9,   1.00,  0,    0,    0,     0),
    (200,     0.95,  40,  0.70,  70,  0.00,  0,    0,    0,     0),
    (1,       1.00,  0,   0.00,  1,   1.00,  1,    0,    0,     0),
    (2,       1.00,  1,   1.00,  7,   0.00,  1,    0,    0,     0),
    (1,       1.00,  1,   1.00,  1,   1.00,  0,    0,    0,     0),
    (2,       1.00,  1,   1.00,  80,  0.00,  0,    0,    0,     0),
    (1,       1.00,  2,   1.00,  1,   1.00,  0,    0,    0.5,   0),
    (3,       1.00,  2,   1.00,  2,   1.00,  0,    0,    0.5,   0),
    (2,       1.00,  1,   1.00,  60,  0.00,  0,    0,    0.5,   0),
    (5,       1.00,  90,  0.00,  4,   1.00,  0,    0,    0.5,   0),
    (4,       1.00,  60,  0.00,  55,  0.00,  0,    1,    1,     0),
    (3,       1.00,  60,  0.00,  4,   1.00,  0,    0,    1,     0),
    (2,       1.00,  80,  0.00,  70,  0.00,  0,    0,    1,     0),
    (4,       1.00,  3,   1.00,  5,   1.00,  0,    0,    1,     0),
    (8,       0.90,  30,  0.00,  6,   1.00,  0,    0,    1,     0),
    (15,      0.80,  90,  0.00,  4,   1.00,  0,    0,    0,     0),
    (40,      0.70,  60,  0.00,  10,  1.00,  0,    0,    0.5,   0),
    (60,      0.90,  3,   1.00,  2,   1.00,  0,    0,    0,     0),
    (12,      0.85,  12,  0.90,  11,  0.80,  0,    1,    0.5,   0),
    (2,       1.00,  9,   0.00,  0,   0.00,  0,    0,    0.5,   0),
    (1,       1.00,  1,   1.00,  0,   0.00,  0,    0,    0.5,   0),
    (6,       1.00,  14,  0.00,  3,   1.00,  0,    0,    0.5,   0),
    # Beside an article: notices, adverts, copyright lines.
    (12,      0.00,  40,  0.00,  14,  0.00,  0,    0,    0,     0),
    (9,       0.00,  90,  0.00,  8,   0.00,  0,    0,    0,     0),
    (16,      0.00,  0,   0.00,  6,   0.00,  0,    0,    0,     0),
    (7,       0.00,  12,  0.00,  30,  0.00,  0,    0,    0,     0),
    (15,      0.00,  3,   0.00,  3,   0.00,  0,    0,    0,     0),
    (2,       0.00,  20,  0.00,  1,   0.00,  0,    0,    0,     0),
    (12,      0.00,  14,  0.00,  90,  0.00,  0,    0,    0,     0),
    (18,      0.00,  60,  0.00,  80,  0.00,  0,    0,    0,     0),
    (7,       0.00,  1,   1.00,  10,  0.00,  0,    0,    0,     0),
    (9,       0.00,  1,   1.00,  12,  0.00,  0,    1,    0,     0),
    (12,      0.10,  40,  0.00,  0,   0.00,  0,    0,    0,     0),
    (11,      0.00,  90,  0.00,  0,   0.00,  0,    1,    0,     0),
    (3,       0.00,  4,   0.00,  2,   1.00,  0,    0,    0,     0),
    (14,      0.00,  6,   1.00,  5,   0.00,  0,    0,    0,     0),
    (20,      0.30,  3,   1.00,  3,   1.00,  0,    0,    0,     0),
    (8,       0.00,  0,   0.00,  1,   1.00,  0,    1,    0,     0),
    (10,      0.00,  30,  0.00,  0,   0.00,  1,    0,    0,     0),
    (2,       0.00,  1,   1.00,  3,   0.00,  0,    0,    0,     0),
    (18,      0.00,  8,   0.00,  0,   0.00,  0,    0,    0,     0),
    # In elements and under names of furniture, however long.
    (66,      0.00,  60,  0.00,  50,  0.00,  1,    0,    0,     0),
    (66,      0.00,  60,  0.00,  50,  0.00,  0,    1,    0,     0),
    (75,      0.00,  4,   0.00,  90,  0.00,  1,    0,    0,     0),
    (75,      0.00,  4,   0.00,  90,  0.00,  0,    1,    0,     0),
    (130,     0.00,  90,  0.00,  0,   0.00,  1,    0,    0,     0),
    (130,     0.00,  90,  0.00,  0,   0.00,  0,    1,    0,     0),
    (220,     0.00,  60,  0.00,  3,   0.00,  1,    0,    0,     0),
    (220,     0.00,  60,  0.00,  3,   0.00,  0,    1,    0,     0),
    (60,      0.00,  80,  0.00,  0,   0.00,  1,    0,    0,     0),
    (400,     0.00,  60,  0.00,  80,  0.00,  1,    0,    0,     0),
    (90,      0.00,  90,  0.00,  90,  0.00,  1,    0,    1,     0),
    (35,      0.00,  5,   0.00,  70,  0.00,  1,    0,    1,     0),
    (9,       0.00,  9,   0.00,  0,   0.00,  1,    0,    0.5,   0),
    (25,      0.00,  30,  0.00,  25,  0.00,  1,    0,    0.5,   0),
    (60,      0.00,  80,  0.00,  70,  0.00,  0,    1,    0,     0),
    (150,     0.02,  90,  0.00,  12,  0.50,  0,    1,    1,     0),
    (3,       0.00,  60,  0.00,  9,   0.00,  0,    1,    1,     0),
    (35,      0.00,  5,   0.00,  70,  0.00,  0,    1,    1,     0),
    (90,      0.00,  90,  0.00,  90,  0.00,  0,    1,    1,     0),
    (1,       0.00,  2,   0.00,  1,   0.00,  0,    1,    1,     0),
    (12,      0.00,  40,  0.00,  30,  0.00,  0,    1,    0.5,   0),
    (80,      0.00,  60,  0.00,  50,  0.00,  0,    1,    0.5,   0),
    (9,       0.00,  0,   0.00,  0,   0.00,  0,    1,    0.5,   0),
    (400,     0.00,  60,  0.00,  80,  0.00,  0,    1,    0.5,   0),
    # In an article: any text, with some links, of any length.
    (3,       0.00,  11,  1.00,  0,   0.00,  0,    0,    1,     1),
    (0,       0.00,  4,   1.00,  0,   0.00,  0,    0,    1,     1),
    (8,       0.00,  2,   1.00,  0,   0.00,  0,    0,    1,     1),
    (1,       0.00,  1,   1.00,  0,   0.00,  0,    0,    1,     1),
    (6,       0.00,  30,  1.00,  0,   0.00,  0,    0,    1,     1),
    (12,      0.00,  0,   0.00,  2,   0.00,  0,    0,    1,     1),
    (5,       0.00,  0,   0.00,  2,   1.00,  0,    0,    1,     1),
    (4,       0.00,  1,   1.00,  2,   1.00,  0,    0,    1,     1),
    (2,       0.00,  0,   0.00,  1,   1.00,  0,    0,    1,     1),
    (3,       0.00,  5,   1.00,  0,   0.00,  0,    0,    1,     1),
    (9,       0.00,  2,   1.00,  0,   0.00,  0,    0,    1,     1),
    (9,       0.00,  0,   0.00,  2,   0.00,  0,    0,    1,     1),
    (15,      0.50,  0,   0.00,  2,   0.00,  0,    0,    1,     1),
    (10,      0.00,  7,   0.00,  90,  0.00,  0,    0,    1,     1),
    (90,      0.00,  10,  0.00,  2,   0.00,  0,    0,    1,     1),
    (2,       0.00,  90,  0.00,  40,  0.03,  0,    0,    1,     1),
    (1,       0.00,  2,   0.00,  12,  0.00,  0,    0,    1,     1),
    (1,       0.00,  0,   0.00,  0,   0.00,  0,    0,    1,     1),
    (40,      0.03,  2,   0.00,  300, 0.00,  0,    0,    1,     1),
    (300,     0.00,  40,  0.03,  9,   0.00,  0,    0,    1,     1),
    (9,       0.00,  300, 0.00,  11,  0.10,  0,    0,    1,     1),
    (25,      0.20,  60,  0.00,  30,  0.10,  0,    0,    1,     1),
    (30,      0.40,  60,  0.00,  30,  0.00,  0,    0,    1,     1),
    (6,       0.00,  2,   0.00,  7,   0.00,  0,    0,    1,     1),
    (1,       0.00,  1,   0.00,  1,   0.00,  0,    0,    1,     1),
    (14,      0.00,  1,   1.00,  6,   0.00,  0,    0,    1,     1),
    (2,       0.00,  3,   1.00,  1,   0.00,  0,    0,    1,     1),
    (5,       0.00,  30,  0.00,  6,   1.00,  0,    0,    1,     1),
    (1,       0.00,  9,   0.00,  2,   1.00,  0,    0,    1,     1),
    (4,       0.00,  2,   1.00,  3,   1.00,  0,    0,    1,     1),
    (900,     0.00,  5,   0.00,  4,   0.00,  0,    0,    1,     1),
    (0,       0.00,  40,  0.00,  40,  0.00,  0,    0,    1,     1),
    (0,       0.00,  2,   0.00,  0,   0.00,  0,    0,    1,     1),
    (110,     0.00,  2,   0.00,  70,  0.02,  0,    0,    1,     1),
    # Long text beside an article, in the run of the text.
    (66,      0.00,  60,  0.00,  50,  0.00,  0,    0,    0,     1),
    (75,      0.00,  4,   0.00,  90,  0.00,  0,    0,    0,     1),
    (130,     0.00,  90,  0.00,  0,   0.00,  0,    0,    0,     1),
    (220,     0.00,  60,  0.00,  3,   0.00,  0,    0,    0,     1),
    (90,      0.10,  3,   0.00,  2,   0.00,  0,    0,    0,     1),
    (400,     0.00,  60,  0.00,  80,  0.00,  0,    0,    0,     1),
    (300,     0.20,  200, 0.00,  70,  0.00,  0,    0,    0,     1),
    (110,     0.00,  0,   0.00,  40,  0.00,  0,    0,    0,     1),
    (150,     0.00,  20,  0.00,  20,  0.00,  0,    0,    0,     1),
    (120,     0.00,  90,  0.00,  80,  0.00,  0,    0,    0,     1),
    (65,      0.00,  90,  0.00,  60,  0.00,  0,    0,    0,     1),
    (90,      0.00,  3,   0.00,  120, 0.00,  0,    0,    0,     1),
    (70,      0.05,  50,  0.00,  5,   0.00,  0,    0,    0,     1),
    (200,     0.00,  0,   0.00,  60,  0.00,  0,    0,    0,     1),
    # Pages without an article: short ones, headings, paragraphs of any length.
    (4,       0.00,  12,  0.00,  0,   0.00,  0,    0,    0.5,   1),
    (6,       0.00,  30,  0.00,  0,   0.00,  0,    0,    0.5,   1),
    (2,       0.00,  8,   0.00,  0,   0.00,  0,    0,    0.5,   1),
    (8,       0.00,  3,   0.00,  0,   0.00,  0,    0,    0.5,   1),
    (0,       0.00,  5,   0.00,  0,   0.00,  0,    0,    0.5,   1),
    (1,       0.00,  0,   0.00,  0,   0.00,  0,    0,    0.5,   1),
    (200,     0.00,  3,   1.00,  0,   0.00,  0,    0,    0.5,   1),
    (30,      0.00,  2,   1.00,  0,   0.00,  0,    0,    0.5,   1),
    (14,      0.00,  1,   1.00,  0,   0.00,  0,    0,    0.5,   1),
    (60,      0.00,  1,   1.00,  0,   0.00,  0,    0,    0.5,   1),
    (4,       0.00,  12,  0.00,  1,   1.00,  0,    0,    0.5,   1),
    (2,       0.00,  30,  0.00,  2,   1.00,  0,    0,    0.5,   1),
    (5,       0.00,  9,   0.00,  2,   1.00,  0,    0,    0.5,   1),
    (12,      0.00,  0,   0.00,  2,   0.00,  0,    0,    0.5,   1),
    (5,       0.00,  0,   0.00,  1,   0.00,  0,    0,    0.5,   1),
    (3,       0.00,  1,   1.00,  9,   0.00,  0,    0,    0.5,   1),
    (4,       0.00,  2,   1.00,  11,  0.00,  0,    0,    0.5,   1),
    (2,       0.00,  1,   1.00,  6,   0.00,  0,    0,    0.5,   1),
    (3,       0.00,  1,   1.00,  2,   0.00,  0,    0,    0.5,   1),
    (2,       0.00,  2,   0.00,  1,   0.00,  0,    0,    0.5,   1),
    (4,       0.00,  0,   0.00,  0,   0.00,  0,    0,    0.5,   1),
    (4,       0.00,  0,   0.00,  13,  0.00,  0,    0,    0.5,   1),
    (13,      0.00,  0,   0.00,  20,  0.00,  0,    0,    0.5,   1),
    (20,      0.00,  13,  0.00,  10,  0.00,  0,    0,    0.5,   1),
    (10,      0.00,  20,  0.00,  0,   0.00,  0,    0,    0.5,   1),
    (6,       0.00,  90,  0.00,  120, 0.00,  0,    0,    0.5,   1),
    (18,      0.00,  70,  0.00,  60,  0.00,  0,    0,    0.5,   1),
    (45,      0.05,  60,  0.00,  50,  0.00,  0,    0,    0.5,   1),
    (120,     0.00,  3,   0.00,  2,   0.00,  0,    0,    0.5,   1),
    (65,      0.00,  90,  0.00,  3,   1.00,  0,    0,    0.5,   1),
    (50,      0.00,  2,   1.00,  60,  0.00,  0,    0,    0.5,   1),
    (70,      0.10,  1,   1.00,  1,   1.00,  0,    0,    0.5,   1),
    (8,       0.00,  2,   0.00,  5,   0.00,  0,    0,    0.5,   1),
    (3,       0.00,  4,   0.00,  9,   0.00,  0,    0,    0.5,   1),
    (5,       0.00,  2,   1.00,  90,  0.00,  0,    0,    0.5,   1),
    (16,      0.00,  45,  0.00,  1,   1.00,  0,    0,    0.5,   1),
    (12,      0.00,  40,  0.00,  0,   0.00,  0,    0,    0.5,   1),
    (7,       0.00,  3,   1.00,  15,  0.00,  0,    0,    0.5,   1),
    (30,      0.40,  60,  0.00,  30,  0.00,  0,    0,    0.5,   1),
    (24,      0.00,  2,   1.00,  2,   1.00,  0,    0,    0.5,   1),
    (0,       0.00,  20,  0.00,  20,  0.00,  0,    0,    0.5,   1),
    (9,       0.00,  12,  0.00,  3,   1.00,  0,    0,    0.5,   1),
    # Pages without an article: labels between the links of menus and lists.
    (2,       0.00,  1,   1.00,  2,   1.00,  0,    0,    0.5,   0),
    (6,       0.00,  1,   1.00,  2,   1.00,  0,    0,    0.5,   0),
    (1,       0.00,  3,   1.00,  4,   1.00,  0,    0,    0.5,   0),
    (4,       0.00,  2,   1.00,  1,   1.00,  0,    0,    0.5,   0),
    (8,       0.00,  4,   1.00,  3,   1.00,  0,    0,    0.5,   0),
    (5,       0.00,  5,   1.00,  0,   0.00,  0,    0,    0.5,   0),
    (3,       0.00,  1,   1.00,  0,   0.00,  0,    0,    0.5,   0),
    (9,       0.00,  2,   1.00,  0,   0.00,  0,    0,    0.5,   0),
    (4,       0.00,  0,   0.00,  2,   1.00,  0,    0,    0.5,   0),
    (2,       0.00,  0,   0.00,  1,   1.00,  0,    0,    0.5,   0),
)


def trained(examples: tuple = EXAMPLES, depth: int = 8):
    """A decision tree: a label, or (feature, threshold, tree up to it, tree beyond it). Splits lower Gini impurity most."""
    table = np.array(examples, float)

    def impurity(y: np.ndarray) -> float:
        return 2 * len(y) * y.mean() * (1 - y.mean()) if len(y) else 0.0

    def grown(rows: np.ndarray, left: int):
        y = rows[:, -1]
        best = None
        if left and 0 < y.mean() < 1:
            for feature in range(rows.shape[1] - 1):
                values = np.unique(rows[:, feature])
                for low, high in zip(values, values[1:]):
                    cut = (low + high) / 2
                    under = rows[:, feature] <= cut
                    gain = impurity(y) - impurity(y[under]) - impurity(y[~under])
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, feature, cut
        if best is None or best[0] <= 1e-9:
            return bool(y.mean() >= 0.5)
        under = rows[:, best[1]] <= best[2]
        return best[1], float(best[2]), grown(rows[under], left - 1), grown(rows[~under], left - 1)

    return grown(table, depth)


def judged(tree, features: np.ndarray) -> np.ndarray:
    """The label of each row of ``features``."""
    if isinstance(tree, bool):
        return np.full(len(features), tree)
    feature, cut, under, beyond = tree
    low = features[:, feature] <= cut
    out = np.empty(len(features), bool)
    out[low], out[~low] = judged(under, features[low]), judged(beyond, features[~low])
    return out


def _names_furniture(name: str, article: bool) -> bool:
    """Whether a name says furniture as a whole: of its words one at least does, and the others are affixes or single letters.

    An article's header is none, by its name as by its element.
    """
    words = re.findall(r"[a-z]+", name.lower())
    return (any(w in _NAMES and not (article and w == "header") for w in words)
            and all(w in _NAMES or w in _AFFIXES or len(w) == 1 for w in words))


def _names_readers(name: str) -> bool:
    """Whether a name as a whole says that readers wrote what is below it."""
    words = re.findall(r"[a-z]+", name.lower())
    said = any(w in _READ for w in words) or any(w in _SAID for w in words) and any(w in _READERS for w in words)
    return said and all(w in _READ or w in _SAID or w in _READERS or w in _NAMES or w in _AFFIXES or len(w) == 1 for w in words)


class _Page:
    """Blocks of one page, gathered in a single pass."""

    def __init__(self):
        self.blocks: list[tuple] = []   # text, words, linked words, furniture (2: by element, 1: by name), article
        self.open: list[tuple] = []     # name, furniture, article, unseen (2: until the next block) of elements that are not inline
        self.parts: list[tuple] = []    # text, inside a link
        self.link = False
        self.inner = 0                  # links open inside an unseen element

    def unseen(self) -> int:
        return self.open[-1][3] if self.open else 0

    def drawn(self) -> bool:
        return bool(self.unseen()) and any(o[0] in _DRAWN for o in self.open)

    def text(self, raw: str) -> None:
        if raw and not self.unseen():
            self.parts.append((raw, self.link))

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(t for t, _ in self.parts)).split())
            if text:
                count = lambda some: sum(1 for w in " ".join(some).split() if _WORD.search(w))
                furniture, article = (self.open[-1][1:3] if self.open else (0, False))
                self.blocks.append((text, count([text]), count(entities.unescape(t) for t, linked in self.parts if linked), furniture, article))
            self.parts = []

    def start(self, name: str, attributes: str) -> None:
        if name == "a":
            if self.unseen():
                self.inner += 1
            else:
                self.link = True
        if name in _INLINE:
            if name == "br":
                self.text(" ")
            return
        self.flush()
        if name in _VOID:
            return
        self.end_open_ended()
        furniture, article = (self.open[-1][1:3] if self.open else (0, False))
        named = [n for m in _NAMED.finditer(attributes) if not (article and name in _ANCHORED and m[1].lower() == "id")
                 for n in (m[2] or m[3] or m[4] or "").split()]
        if name in _ARTICLE:
            # A page's main part is main whatever its frame is called; comments are often articles of their own.
            article = True
            if name == "main" and furniture == 1:
                furniture = 0
            if name == "article" and any(map(_names_readers, named)):
                furniture = 2
        elif name not in ("html", "body"):
            if (name in _FURNITURE or name == "header" and not article or any(map(_names_readers, named)) or _HIDDEN.search(attributes)):
                furniture = 2
            elif any(_names_furniture(n, article) for n in named):
                furniture = max(furniture, 1)
        self.open.append((name, furniture, article, self.unseen()))

    def start_unseen(self, name: str, is_closed_later: bool) -> None:
        self.flush()
        self.end_open_ended()
        if not self.unseen():
            self.inner = 0
        furniture, article = (self.open[-1][1:3] if self.open else (0, False))
        self.open.append((name, furniture, article, self.unseen() or (1 if is_closed_later else 2)))

    def end_open_ended(self) -> None:
        while self.unseen() == 2:
            self.open.pop()

    def end(self, name: str) -> None:
        if name == "a":
            if self.unseen() and self.inner:
                self.inner -= 1
            else:
                self.link = False
        if name in _INLINE:
            return
        self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i:]
                break


def _closing(name: str) -> re.Pattern:
    """The closing tag of ``name``, which is one of a few; letters of ASCII only count as equal in either case."""
    return re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A)


def _closes_itself(attributes: str) -> bool:
    """Whether a tag ends in '/>'; a slash that ends a value without quotes is the value's."""
    return attributes.endswith("/") and not re.search(r"=[^\s\"'=]+/\Z", attributes)


def blocks_of(html: str) -> list[tuple]:
    """(text, words, linked words, furniture around it (2: by element or as reader comments, 1: by name), inside an article) of each block."""
    page, at, size = _Page(), 0, len(html)
    last_close: dict[str, int] = {}
    while at < size:
        found = _PART.search(html, at)
        if not found:
            page.text(html[at:])
            break
        page.text(html[at:found.start()])
        at = found.end()
        name, attributes = (found[2] or found[5] or "").lower(), found[3] or found[6] or ""
        if not name:
            continue
        if found[1] or found[4]:
            page.end(name)
        elif name in _RAW:
            page.flush()
            if page.drawn() and _closes_itself(attributes):
                continue
            close = _closing(name).search(html, at)
            if not close:
                break
            at = close.start()
        elif name in _UNSEEN:
            if name in _DRAWN and _closes_itself(attributes):
                page.flush()
                continue
            if name not in last_close:
                last_close[name] = max((m.start() for m in _closing(name).finditer(html, at)), default=-1)
            page.start_unseen(name, last_close[name] >= at)
        else:
            if name == "p" and page.open and page.open[-1][0] == "p":
                page.end("p")
            page.start(name, attributes)
    page.flush()
    return page.blocks


def main_texts(pages: list[str], tree) -> list[str]:
    rows, texts, first = [], [], [0]
    for html in pages:
        own = blocks_of(html)
        numbers = [(b[1], b[2] / max(b[1], 1)) for b in own]
        around = [(0, 0.0), *numbers, (0, 0.0)]
        without = 0.0 if any(b[4] and b[3] < 2 for b in own) else 0.5
        rows += [(*here, *before, *behind, b[3] == 2, b[3] == 1, 1.0 if b[4] else without)
                 for b, before, here, behind in zip(own, around, around[1:], around[2:])]
        texts += [b[0] for b in own]
        first.append(len(texts))
    stays = judged(tree, np.array(rows, float).reshape(-1, 9))
    return ["\n".join(texts[i] for i in range(a, b) if stays[i]) for a, b in zip(first, first[1:])]


def with_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text (kept blocks in order, a line each) and n_chars (its code points)."""
    ship_code(pages.sparkSession)
    rest = pages.drop(*({"text", "n_chars"} - {html}))
    kept = [c for c in rest.columns if c not in ("text", "n_chars")]
    schema = T.StructType([*(f for f in rest.schema.fields if f.name in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    tree = trained()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = batch.column(html).to_pylist()
            texts: list[str] = []
            for a, b in portions([r or "" for r in raw]):
                texts += main_texts([r or "" for r in raw[a:b]], tree)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=[*kept, "text", "n_chars"])

    return rest.mapInArrow(extract, schema)
