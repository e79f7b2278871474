"""The labelled table on which the markup model is trained: snippets written for it and the kinds of markup that they hold.

Every node found in a snippet is a positive example if its family is named, else a negative one. No snippet follows a text
of the test tables. ``noise`` adds snippets without markup by rule, and ``documents`` longer texts of several snippets and
plain sentences, so that the model doesn't take the size of a text for a sign. At most ``MAX_ROWS`` texts are used.
"""

from __future__ import annotations

import base64
import random

MAX_ROWS = 1500

SNIPPETS = [
    ("html", "<p>Bees sleep at night.</p>\n<p>They fly at dawn &amp; rest at noon.</p>"),
    ("html", "A <b>short</b> walk and a <em>long</em> swim<br>end at <a href=\"/lake/7\" title=\"Lake\">the lake</a>."),
    ("html", "<div class=\"box\"><h3>Tools</h3>\n<ul>\n<li>saw</li>\n<li>plane</li>\n</ul></div>"),
    ("html", "Come early&nbsp;or late &mdash; we are open."),
    ("html", "It&#8217;s cold<br />and wet.<!-- advert slot 4 -->"),
    ("html", "<H1>Menu</H1>\n<span style='color:red'>Soup</span> costs <i>four</i> euros."),
    ("html", "<!DOCTYPE html>\n<html lang=\"en\"><head><title>Moss</title></head><body>\n<table width=\"90%\"><tr><th>oats</th><td>5</td></tr></table>\n</body></html>"),
    ("html", "<pre><code>\nprint(total, 8);\n</code></pre>"),
    ("html", "<img src=\"/pic/fox.jpg\" alt=\"a fox\" width=\"40\"> says &quot;hello&quot; &lt;softly&gt;"),
    ("html", "Prices<br><br>\nOrders<br>"),
    ("html", "The guest went home.</p>"),
    ("html", "Bread &amp; butter for two."),
    ("html", "<script type=\"text/javascript\">var a = 1;</script>\n<style>p { color: red }</style>\n<nav id=\"top\"><a href=\"#x\" rel=\"nofollow\">Up</a></nav>"),
    ("html", "<blockquote><p>Never again.</p></blockquote><hr/>"),
    ("html", "<input name=\"q\" type=\"text\" value=\"\"><button>Go</button>"),
    ("html", "<h2>The old fort</h2>\nThe fort fell in 1640.<sup>2</sup>"),
    ("html", "Caf&eacute; and na&iuml;ve, 5&deg; &euro;7 &copy; 2001"),
    ("html", "<ol><li>one</li><li>two</li></ol>\n<small>three</small>"),
    ("markdown", "# Growing mint\nMint likes shade.\n## Soil\nUse **rich** soil."),
    ("markdown", "A *small* pot and a **large** one."),
    ("markdown", "Read [our guide](/guide.html) or run `install`."),
    ("markdown", "Do _not_ water at noon."),
    ("markdown", "```python\nprint(total, 8)\n```"),
    ("markdown", "~~~\nvalue = table[4]\n~~~"),
    ("markdown", "```\nmake all\nmake test\n```\nDone."),
    ("markdown", "| pot | size |\n|---|:--:|\n| clay | 14 |"),
    ("markdown", "|:---|---:|\n| tin | 9 |"),
    ("markdown", "### Watering\n#### In winter\n###### Notes"),
    ("markdown", "We **never** use peat."),
    ("markdown", "`water` it, then `wait`."),
    ("markdown", "The [nursery](/n) opens at nine, see ![plan](/p.png)."),
    ("markdown", "Some *of* it grows *fast*, and __all__ of it smells."),
    ("markdown", "- **mint**: shade\n- **thyme**: sun\n- [basil](/basil)"),
    ("markdown", "## 7 quick ways to dry herbs\nHang them.\n# 2. Oven\n### 40 Ideas For A Balcony"),
    ("markdown", "# 12 good years\nThe firm grew.\n## A Dry Summer, Field Press, 1931"),
    ("markdown", "## Home | News | Shop\n# © 2014 Herb News\n### (Read on)"),
    ("wiki", "'''Dunmore''' is a [[village]] on the [[River Oise|Oise]].\n== Weather and soil ==\nIt is mild."),
    ("wiki", "{{Infobox lake | name = Oise | depth = 41 }}\nThe ''deep'' lake."),
    ("wiki", "{| class=\"infobox\"\n|-\n! year !! guests\n|-\n| 1920 || 310\n|}"),
    ("wiki", "{|\n! a !! b !! c\n|-\n| 4 || 5 || 6\n|}"),
    ("wiki", "The hall closed.\n[[Category:Halls of Dunmore]]\n[[File:Hall.jpg|thumb|The hall]]"),
    ("wiki", "=== Early days ===\nThe bridge was sold."),
    ("wiki", "== Partners ==\n==== Further uses ====\nNone."),
    ("wiki", "The ''only'' bridge, see [[Oise]]."),
    ("wiki", "{{Taxobox {{small|moth}} | name = {{nowrap|Grey moth}} | size = 4}} It flies."),
    ("wiki", "{{Chart|{{a|b}}}}\nIt {{convert|4|km|{{mi}}}} long."),
    ("wiki", "{{cite web|url=x|title=Y}} {{stub}} {{main|Bridges}}"),
    ("wiki", "== 6 small ways to save a bridge ==\nPaint it.\n=== 9 Old Bridges, River Press, 1944 ==="),
    ("wiki", "== Home > Lakes ==\n== 41 shares ==\n=== « Older ===\n== © 2012 =="),
    ("wiki", "'''Bold''' and ''thin'' and '''''both'''''."),
    ("latex", "\\section{Results}\nThe \\emph{third} sample, see~\\cite{lee04} and \\ref{fig}."),
    ("latex", "\\begin{enumerate}\n\\item first\n\\item second\n\\end{enumerate}"),
    ("latex", "We see that $\\gamma - 2\\delta$ falls."),
    ("latex", "\\begin{align} y &= \\sqrt{7} \\end{align}"),
    ("latex", "$$\\int_0^1 f(x) dx = \\frac{3}{4}$$"),
    ("latex", "\\[ a \\geq b + 1 \\]"),
    ("latex", "The $y_{3} = z^4$ curve is \\textbf{flat} and \\textit{smooth \\emph{here}}."),
    ("latex", "\\chapter{Lakes}\n\\subsection*{Depth}"),
    ("latex", "It \\emph{rained}. \\noindent Then \\LaTeX{} ran."),
    ("latex", "\\documentclass{article}\n\\usepackage[utf8]{inputenc}\n\\label{eq:1}"),
    ("latex", "so $n^2$ and $k \\leq 8$ and \\( u = v \\)"),
    ("html markdown", "<p>The **second** sample</p>\n# Lakes"),
    ("html wiki", "|}<img src=\"/b.png\" alt=\"lake\">\nThe [[lake]] &amp; '''hill'''"),
    ("latex html", "\\emph{cold} &nbsp; $\\frac{2}{k}$"),
    ("markdown wiki", "### {| class=\"plain\"\n## |-\n[[lake]] and **hill**"),
    ("markdown latex", "**see** \\section{Depth} and [x](/y) with $\\beta$"),
    ("", "The level was < 40 although the limit was > 90. See note [7] about it, and [12]."),
    ("", "A ticket cost $14 here and $26 in Lyon. A map cost $3 there and $5 at home."),
    ("", "A BOOK COST $40 HERE AND $55 IN LYON."),
    ("", "The bus costs $2 in Nice. Few in Lyon paid it. The tram costs $4."),
    ("", "*** START OF THE PROJECT LYON EBOOK A WALK ***\nA WALK"),
    ("", "*** END OF THIS PROJECT LYON EBOOK A WALK ***\n*** The End ***"),
    ("", "* oak beam\n* pine beam\n- nails\n+ glue\n• paint\n› brush"),
    ("", "1. oak\n2) pine\n(3) fir\na) elm"),
    ("", "The file report_final_9 was empty. The file table_of_lakes_2 was not."),
    ("", "[Read also: A walk in Lyon]\nItem #88 was sold. [continued]"),
    ("", "Home > Walks > Lyon\nHome / Walks / Lyon\nMaps | Guides | Tours"),
    ("", "    if total > 4:\n      return table[9]\nprint(total, 8);\nlake = bridge.find(6)"),
    ("", "oak | pine | fir\n3.14 | 2718 | elm\n| oak | pine |\n| fir | 22 |"),
    ("", "oak,pine,fir\n4.5,n/a,Lyon\noak;pine;n/a"),
    ("", "Miller & Daughters sold R&D maps; AT&T; closed."),
    ("", "2021-02-03T04:05:06 INFO lake.sensor code=3 took=9ms"),
    ("", "Oak ..... 7.10\nPine -- 5\n---\n=====\n* * *\n~~~~~"),
    ("", "4 * 5 * 6 is 120, and 8 > 2 < 9. The walkers' map, 'twas old."),
    ("", "Ask @lyonwalks. We meet @ the gate at 9:30. Part no. 551-20-77, see [4] and [19]."),
    ("", "‹ 1 2 3 … 8 ›\n« Back\nTags: oak, pine\n© 2015 Walk News."),
    ("", "<guide@walks.example> wrote on Friday: 7 <9 and 2<3"),
    ("", "print(total, 8);\nreturn table[9]\nif total > 4:\ntotal = lake.sum(3)"),
    ("", "#1 in Lyon, #7 in Nice; C# and F#."),
    ("", "oak --pine 3\nthe guide - who sang - left; the bus -- late -- came"),
    ("", "He won 3-2, then 4-0; 50% of £9 = £4.50 ~ 5 €."),
    ("", "a|b|c and x=y and p_q and 5^2 and {k} and [k]"),
    ("", "Q: How far? A: 12 km. -- Then > he said\n> and left."),
]

MARKS = "#*_=~+-.:;!?&@^%`$|'[]{}<>\\/"
WORDS = "mint lake walk oak bridge fox bee soup".split()


def noise(lines: int = 300, seed: int = 5) -> list[tuple[str, str]]:
    """Snippets that hold no markup, by rule: runs of marks, encoded data, and letters in a wrong encoding."""
    pick = random.Random(seed)
    out = []
    for k in range(lines):
        if k % 8 == 6:
            out.append(("", "\n".join(base64.b64encode(pick.randbytes(45)).decode() for _ in range(3))))
        elif k % 8 == 5:
            between = lambda: " ".join(pick.choice(WORDS) for _ in range(pick.randint(1, 9)))
            price = lambda: f"${pick.choice((pick.randint(1, 99), pick.randint(100, 9999), round(pick.uniform(1, 90), 2)))}"
            out.append(("", " ".join(f"A {between()} cost {price()} {between()} and {price()} {between()}." for _ in range(pick.randint(1, 3)))))
        elif k % 8 == 7:
            words = ["".join(pick.choice("abcdeiloprstéèüöñç–’“") for _ in range(pick.randint(2, 9))) for _ in range(8)]
            out.append(("", " ".join(words).encode().decode("cp1252", "replace")))
        else:
            rows = []
            for _ in range(pick.randint(1, 3)):
                marks = "".join(pick.choice(MARKS[: 16 if k % 3 else len(MARKS)]) for _ in range(pick.randint(12, 50)))
                rows.append(f"{pick.choice(('', '', '!', '|', '**', '__', '#', '=', '`'))}{marks} {pick.choice(WORDS)} {pick.randint(1, 9999)}")
            out.append(("", "\n".join(rows)))
    return out


SENTENCES = [
    "Nothing much happened that year.", "They walked along the shore, and then they went home.", "Everyone knew the tune, but nobody sang.", "It was cold; the door stayed shut.", "Who would pay for it?",
    "A second letter came in March.", "The road bends twice before it meets the sea.", "In 1931 the firm had 40 workers.", "\"Take it,\" she said, and left.", "Half of the crop was lost, the rest was sold at once.",
]


def formula(pick: random.Random) -> str:
    """A formula of random terms between random marks, alone or in a sentence."""
    letter = lambda: pick.choice("abdefgkmpqrstuvwyz")
    term = lambda: pick.choice((f"\\{pick.choice(('gamma', 'delta', 'pi', 'omega', 'lambda', 'theta'))}", f"{letter()}_{{{pick.randint(1, 9)}}}", f"{letter()}^{pick.randint(2, 9)}", f"\\frac{{{letter()}}}{{{pick.randint(2, 99)}}}", f"\\sqrt{{{pick.randint(2, 99)}}}", f"\\sum_{{{letter()}=0}}^{{{pick.randint(2, 99)}}} {letter()}", f"\\int {letter()}", letter(), str(pick.randint(1, 99))))
    body = term() + "".join(f" {pick.choice(('+', '-', '=', '<', chr(92) + 'geq', chr(92) + 'cdot'))} {term()}" for _ in range(pick.randint(1, 4)))
    if not set(body) & set("\\^_"):
        body += f" = {letter()}^2"
    a, b = pick.choice((("$", "$"), ("$", "$"), ("$$", "$$"), ("\\[ ", " \\]"), ("\\( ", " \\)")))
    return pick.choice(("{}", "So {} holds.", "We put {} here.")).replace("{}", f"{a}{body}{b}")


def documents(count: int = 700, seed: int = 9) -> list[tuple[str, list[tuple[int, str]]]]:
    """(text, its parts as (start, kinds)): every snippet alone, and ``count`` texts of snippets and plain sentences."""
    pick = random.Random(seed)
    marked, plain = [x for x in SNIPPETS if x[0]], [x for x in SNIPPETS if not x[0]] + noise()
    out = [(text, [(0, kinds)]) for kinds, text in SNIPPETS + noise()]
    for _ in range(count):
        families = pick.sample(("html", "markdown", "wiki", "latex"), pick.randint(0, 2))
        own = [x for x in marked if set(x[0].split()) <= set(families)]
        text, parts = "", []
        for _ in range(pick.randint(2, 16)):
            k = pick.random()
            kinds, piece = pick.choice(own) if own and k < 0.4 else pick.choice(plain) if k < 0.55 else ("", " ".join(pick.choice(SENTENCES) for _ in range(pick.randint(1, 6))))
            if "html" in families and pick.random() < 0.2:  # paragraphs of any length
                tag = pick.choice(("p", "P", "div", "li", "td", "blockquote"))
                kinds, piece = "html", f"<{tag}>{' '.join(pick.choice(SENTENCES) for _ in range(pick.randint(1, 25)))}</{tag}>"
            if "latex" in families and pick.random() < 0.2:
                kinds, piece = "latex", formula(pick)
            parts.append((len(text), kinds))
            text += piece + pick.choice((" ", " ", "\n", "\n\n") if "\n" not in piece else ("\n", "\n\n"))  # also within a line of prose
        out.append((text, parts))
    return out
