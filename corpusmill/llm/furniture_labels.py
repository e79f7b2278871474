"""The labelled table on which the page furniture tree is trained: pages written for it, one line each with its label.

``-`` marks furniture, ``+`` the page's own content; a line of ``=`` ends a page. No line follows a text of the test
tables. ``pages`` adds pages made of the same runs of lines in other orders, and menus of other lengths, so that the tree
doesn't learn one page's order. At most ``MAX_ROWS`` rows are used.
"""

from __future__ import annotations

import random

MAX_ROWS = 20_000
MENU = "Home|About us|Contact|Help|FAQ|Privacy|Terms|Sitemap|Blog|News|Shop|Cart (0)|Search|Log in|My account|Jobs|Press|Team|Support|Forum|Gallery|Videos|Members|Donate|Prices|Events|Recipes|Archive|Catalogue".split("|")
CELLS = "willow copper anvil lisbon candle porto sparrow granite meadow walnut pepper silk barley bronze faro velvet".split()
MARKS = (" | ", " · ", " • ", " > ", " / ", "  ", " — ", " » ", " :: ")

PAGES = """
- Skip to page content
- Open menu
- Home | Recipes | Videos | About | Contact
+ Slow-cooked lentils with lemon
+ Lentils need no soaking, which makes them the best friend of a tired cook.
+ What you need
+ 250 g green lentils
+ 2 cloves garlic
+ 1 lemon, grated
+ Bring the pot to a boil and let it simmer for forty minutes. Stir it twice.
- ADVERTISEMENT
+ My grandmother always added a spoon of mustard at the end!
- Print recipe
- Email this to someone
- Tags: lentils, dinner, vegan
- 14 comments
- Leave a comment
- Related recipes
- Baked beans the old way
- Ten soups for cold evenings
- A Better Way To Boil Rice
- Privacy policy
- © 2021 Kitchen Diary. All rights reserved.
=
- Menu
- News / Sport / Weather / Travel / Jobs
- This website uses cookies. Accept all
- We and our partners store data on your device to show personal ads.
+ City council votes for a second tram line
+ The city council voted on Tuesday evening to build a second tram line to the airport. It will cost 84 million euros.
- Story continues below
+ Opponents said the money was needed for schools. The mayor disagreed: "A city that stands still falls behind."
+ Reaction
+ Shop owners along the route welcomed the plan, although some fear two years of dust and noise.
- Follow us on social media
- Share on social media
- Read also: Why the first tram line was late
- See also: Bus drivers accept new contract
- Most popular
- Fire destroys warehouse near port
- 5 Things To Know Before The Marathon
- Mayor opens new library in Westend
- Newer posts
- Older posts
- Sign up for our morning newsletter
- Powered by NewsPress
=
- Skip navigation
- Home > Science > Space
- Please turn on JavaScript to see this site properly.
+ A comet returns after 400 years
+ Astronomers in Chile photographed the comet last night, shortly before the moon rose.
+ It was seen in 1620 by monks who took it for a sign. Nobody had expected it back so soon.
+ How to see it
+ 1. find a dark place
+ 2. look to the west
+ 3. use binoculars
+ The comet will be brightest in March, and it can be watched without a telescope.
- Promoted
- You might also like
- The moons of Jupiter explained
- What Happens Inside A Black Hole
- Seven telescopes under 200 dollars
- 203 shares
- Page 1 of 4
- Next page
- Subscribe now and get every issue by mail.
- Terms of use | Privacy | Imprint
=
- Toggle menu
- Search this site
- HOME   NEWS   GALLERY   MEMBERS   CONTACT
+ Club trip to the mountains
+ We left at six in the morning, and by noon all of us stood on the ridge.
+ The weather was kind to us. We ate our bread, and our guide told us about the glacier.
+ You could see four countries from there, he claimed, but we counted only two.
- Posted by admin
- Posted in trips
- Filed under: walking, mountains
- Permalink
- No comments yet
- Add a comment
- Recent posts
- Minutes of the spring meeting
- New boots for old feet
- Photos from the lake
- Archives
- March (12)
- April (7)
- May (23)
- Back to top
- Designed by Peak Web
- Theme by Alpine
=
- Cookies help us deliver our services. By using our services, you agree to our use of cookies.
- Home » Shop » Tools » Garden tools
+ Steel spade with ash handle
+ A strong spade for heavy soil. The blade is forged from one piece and is guaranteed for ten years.
+ | weight | 2.1 kg |
+ |---|---|
+ | length | 112 cm |
+ | blade | 29 cm |
- Add to cart
- Click on the picture to zoom in
- Customers also bought
- Leather gloves with long cuffs
- Rake, fourteen teeth
- Log in to see your orders
- Your cart is empty
- Categories
- Spades (14)
- Rakes (9)
- Hoes (22)
- Watering cans (31)
- Help · Shipping · Returns · Contact us · Terms
- Copyright 2015-2022 Garden & Field Inc.
=
- Jump to content
- Register
- Log in
- Forum
- FAQ
+ Why does my bread collapse?
+ I have tried three recipes, and every time the loaf falls in when I open the oven. What am I doing wrong?
+ Your dough is too wet. Weigh the flour instead of using cups, and give it less time to rise.
+ That worked. Thank you, it was the flour!
- Reply
- Report this post
- Print this thread
- « 1 2 3 4 »
- Previous thread
- Next thread
- Your browser is not supported. Please update it.
- To continue, please enable cookies in your browser settings.
=
- Main menu
- About us
- Our team
- Careers
- Press
- Contact
+ History of the bank
+ The bank was founded in 1871 by four merchants from Hamburg.
+ Early years
+ In its first ten years it financed a railway, two harbors and a sugar factory.
+ After the crisis of 1931, the owners sold their shares to the state.
+ The cookie factory next door was its last private customer, and its account was closed in 1935.
- Download our app
- Become a member and support independent journalism.
- Join our community of 40,000 savers
- Join 250 other members
- Legal notice
- Site map
- The bank is not responsible for the content of external sites.
=
- [Skip to main navigation]
- HOME / BLOG / ABOUT / SHOP
+ # Sharpening a chisel
+ A blunt chisel is more dangerous than a sharp one, because you push harder.
+ ## Stones
+ Start with a coarse stone, and finish on leather.
+ - coarse stone
+ - fine stone
+ - leather strop
+ ```
+ angle = blade.measure(25)
+ ```
+ **Never** grind it dry.
- ## Related articles
- How to true a plane
- Old saws worth saving
- A Guide To Wood Glue
- ## Categories
- Planes (8)
- Chisels (17)
- [Read more]
- Subscribe
- Get new posts by email
- Enter your email address to subscribe to this blog.
=
- <b>Menu</b>
- <p>We use cookies to give you the best experience. <a>Settings</a></p>
+ <h1>Rivers of the north</h1>
+ <p>The river rises in a bog and is joined by two streams before it reaches the plain.</p>
+ <ul>
+ <li>trout</li>
+ <li>perch</li>
+ </ul>
+ <p>In summer its bed is dry, so cattle cross it.</p>
- <h3>Share this page</h3>
- <p>Advertisement</p>
- <h3>Latest news</h3>
- Fishing season opens early
- Dam repairs will take two years
- <small>© 2018 Rivers Trust</small>
=
- Startseite | Produkte | Kontakt
- Home > Produkte > Fahrräder
+ Das neue Rad aus Holz
+ Der Rahmen ist aus Esche gebaut, und er wiegt kaum mehr als einer aus Stahl.
+ Die Werkstatt liegt in einem Dorf bei Ulm. Dort arbeiten vier Leute.
- Advertisement
- Read more
- Copyright 2020 Holzrad GmbH
=
+ Le marché du samedi
+ Le marché est plein de monde, mais le pain manque toujours avant midi.
- Newsletter
- Share
- Tweet
+ La plaza se llena de gente cuando suena la música, y nadie quiere volver a casa.
- Powered by Marché Web
- More from this author
- How a market town survived
- Old stalls and new
- The Price Of A Cabbage
=
+ === Trade and guests ===
+ The district lives from timber and from summer guests.
+ {| class="table"
+ ! year !! guests
+ |-
+ | 1990 || 14,200
+ |}
+ [[Category:Districts]]
+ {{Infobox town | name = Rauma | area = 41 }}
- == Sponsored links ==
- == See more ==
+ \\section{Method}
+ \\begin{itemize}
+ \\item first sample
+ \\end{itemize}
+ $$E = m c^2$$
+ Equation (3) holds for all $n > 2$.
=
+ 2023-11-04T08:12:44 ERROR pump.motor state=7 wait=120ms
+ 2023-11-04T08:12:49 INFO pump.motor state=8 wait=4ms
+ for (i = 0; i < 9; i++) {
+   total = total + weight[i];
+ }
+ if weight > 40:
+   print(weight)
+ open(valve, 4);
+ return pump[3]
- Menu
- News · Contact · Search · Log in
- Load more
=
+ tomato | basil | cheese
+ 14.20 | 8.75 | Lisbon
+ Lisbon | n/a | 118 | 4.2 | Porto
+ copper    tin    zinc    lead
+ 41.2    Porto    17    n/a
+ Lisbon	Porto	Faro	Braga
+ apple,pear,n/a,14.5,Braga
+ pear;n/a;cherry;Faro
+ willow | poplar | birch | alder | maple | beech
+ spoon : 4 : 12.50
+ ab39xK20qPzLmN84vRtY71sWcUeJ55hGoDfB
+ Qx7Lp+0aZ/9tR4mVnE2kYc8WbS6uHd1JgFiO3
+ #=~*+_^ %& 33 ?!;:
- Archive | Videos | Shop | Help | Donate
- TEAM | EVENTS | PRESS | SITEMAP
- JOBS | FAQ | TERMS
=
+ Timetable, winter
+ Airport 06:10 06:40 07:10
+ Harbor 06:25 06:55 07:25 Mon-Fr
+ Castle 06:31 07:01 Sun
- Advertisement - article continues below
+ Fares
+ Adult ........ 3.20
+ Child ........ 1.60
+ Dog - 1.00
+ Timetable  changes  in  April.
- Contact us
- Help
- Log out
=
- Our website relies on cookies and other tracking tools to work.
- By visiting this website you consent to our privacy policy.
- We value your privacy. Manage preferences
- Please accept cookies to continue
- JavaScript is disabled in your browser.
- NOTICE: This page requires JavaScript.
- This site stores small files in your browser to remember your settings.
- The Evening Post uses your data to improve its service. Learn more
- Close this message
+ Fox in the henhouse
+ THE FARMER WOKE AT FOUR AND FOUND NINE HENS DEAD.
+ the fox had come through a hole in the fence, he said later.
+ "I will not use poison," he told us, "because of the dogs."
+ Privacy was rare on a farm with nine children, and the menu never changed: soup, bread and cheese.
+ The press came from the city to see the fence. A team of four built a new one.
+ See page 12 for help with fences.
- Continue reading with a free account.
- Create a free account to read this story.
- Support our work: donate today.
- Don't miss our weekly letter from the farm.
- Get the best stories in your inbox.
=
- Home :: Music :: Reviews
- Home / Music / Concert hall
- Music > Concert hall
+ An evening with four cellos
+ Four cellos can be louder than an orchestra, if the hall is small.
+ - Bach
+ - Vivaldi
+ * Dvorak
+ (1) encore
+ They played for two hours without a break. Who would have thought it possible?
- Share this:
- Share: Mail  Print  Copy link
- Comments (12)
- Comments are closed.
- 3 Comments
- Tagged: music, cello
- Editor's picks
- Trending
- The quiet pianist of Riga
- 12 Songs For A Long Drive
- How Vienna Lost Its Opera
- Concert and dinner in Prague
- ‹ Prev 1 2 3 Next ›
- ← Older
- Next: The last violin maker
- Previous: A night at the opera
=
- EVENTS — PRESS — BLOG — LOGIN
- Videos   Search   Cart (2)   My account
- Cart (0) • Help • Search • Sitemap
+ Opening hours
+ Monday to Friday, the library opens at nine.
+ Children under twelve read free.
+ Story hour
+ On Saturdays, volunteers read to children in three languages; parents wait in the garden.
- Ad
- Sponsored content
- New on the blog
- New books in May
- Reading under an oak
- Five poets you should know
- Subscribe to our feed
- All content © City Library
- Built with PageKit
- Last updated by webmaster
=
- Gallery
- Donate
- Shop
- Blog
- Search
+ Small gardens
+ Brave neighbors
+ Quiet streets
+ A bench under a tree is enough for a garden. People met there every evening until the tree fell.
+ How to water
+ 10 plants for dry soil
+ Everyone in Lisbon has a pot of basil, even those who never cook.
- Sign in to leave a reply
- Show more
- View all posts
- Latest posts
- Basil on the balcony
- 6 quick ways to save water
- A Balcony In Porto
- Recent comments
- Old pots and new plants
- The gardener of Faro
- Copyright 2009 Basil & Friends
- This site is not responsible for external links.
=
+ Winning at chess
+ cheap chess sets buy online Lisbon
+ best chess clock order Porto
+ chess lessons Faro price
- Home
- Terms
- Privacy
- Sitemap
- Advertise with us
+ Chess
+ The board, the clock and the table were all the room held. In 1958, a boy of nine beat the master there.
+ A famous game lasted eleven hours!
+ Read the notes to game [4] and to game [7].
+ 3. Bb5 a6 4. Ba4
=
- Videos  Podcasts  Events  Help  Log in
+ The harbor at night
+ The  harbor  is  never  dark.  Ships  come  and  go,  and  the  cranes  work  until  dawn.
+ IN  1962,  A  STORM  SANK  ELEVEN  SHIPS  THERE.
+ Contact between ship and pier broke nine ribs of the hull.
+ News of the wreck reached the shop by morning, and the team went home.
+ About forty people help in the archive every week.
- Home » Harbor » Crane and pier
- Home > Boats > Engine room
- Recommended for you
- Anchors and chains of Bergen
- The Last Pilot Of Oslo
- 9 harbors you can walk to
- Like this article?
- Back to home page
- Get our app
- Your privacy choices
=
- NEWS   SPORT   SHOP   CART (1)   LOGIN
- Sport / Football / League two
+ United lose again
+ United lost 0-3 at home and are now last.
- Article continues after advertisement
+ The coach blamed the pitch. "We could not run on that," he said.
- Tap to enlarge
+ Five thousand fans left before the end, and the shop closed early.
- More news
- Keeper breaks arm in training
- Young striker signs for Porto
- A Cup Final To Forget
- More stories from the league
- Print
- Email
- Share
- Subscribe to updates
- Accept cookies
- Photo credits: United FC
=
- Team · Jobs · Press · Blog · Contact
- Home / Tools / Hammer and nail
+ Golden archives
+ The old archive of Riga
+ Local recipes
+ • small archive
+ + tiny gallery
+ - open forum
+ * shop counter
+ 2. blog engine
+ | oven | news |
+ | gallery | 7 |
+ | saw | plane |
+ if pressure > 18:
+ if level > 3:
+ while depth > 2:
+ 500 ml warm milk
+ 75 g dark sugar
+ 30 g fresh yeast
+ 12 pcs dried figs
+ 2 tbsp sweet syrup
- Share this:  Mail  Copy  Save (41)
- Share:  Mail  Print  Save
- Share on:  Mail  Copy link (7)
- ADVERTISEMENT - keep reading
- Advertisement · the text goes on
+ print(menu[3])
+ return archive[7]
+ team = press.start(9)
+ if shop > 12:
+ Gallery floor: 40
+ A gallery in Riga was robbed twice: once by night, once at noon.
+ Privacy meant little in a house with one room.
+ == See also ==
+ n/a | n/a | n/a
+ n/a | Porto | n/a | 12.4
+ Iron — copper — tin — zinc
+ 410 pcs steel screws
+ 3 tbsp olive oil
+ ### Tools
+ ### 12 tools for every home
+ Hammer handles:
+ See the FAQ of the maker for details, or ask an old carpenter, since he knows more.
- ### Newsletter
- ### Top stories
- A hammer for life
- The Best Glue For Oak
- 4 nails you should not buy
- == Share this ==
- <h2>Recent articles</h2>
- Saws from Sheffield
- How steel is hardened
- ABOUT / TEAM / CONTACT / SEARCH / PRESS
- Donate · Forum · Members · Gallery
- Prices | Recipes | Events | Forum | Support
- SUPPORT > FORUM > MEMBERS
=
"""


def menu(r: random.Random) -> str:
    """A menu of random labels."""
    out = r.choice(MARKS).join(r.sample(MENU, r.randint(3, 12)))
    return out.upper() if r.random() < 0.3 else out


def row(r: random.Random) -> str:
    """A row of a table of random cells."""
    cell = lambda: r.choice((r.choice(CELLS), r.choice(CELLS).title(), "n/a", str(r.randint(1, 99_999)), f"{r.randint(1, 99)}.{r.randint(10, 99)}"))
    return r.choice((" | ", "    ", "\t", ",", ";")).join(cell() for _ in range(r.randint(3, 7)))


def spoiled(r: random.Random, line: str) -> str:
    """The line as it is, in capitals, or with wide gaps."""
    k = r.random()
    return line.upper() if k < 0.06 else line.replace(" ", "  ") if k < 0.12 and len(line) > 40 else line


def pages(mixed: int = 400, seed: int = 11) -> list[list[tuple[bool, str]]]:
    """(whether furniture, line) of each line of the labelled pages and of ``mixed`` pages of their runs in random order."""
    r = random.Random(seed)
    known = [[(row[0] == "-", row[2:]) for row in page.split("\n") if row] for page in PAGES.split("\n=\n")]
    runs: list[list[tuple[bool, str]]] = []
    for page in known:
        for k, line in enumerate(page):
            if k and line[0] == page[k - 1][0]:
                runs[-1].append(line)
            else:
                runs.append([line])
    ours, theirs = [x for x in runs if x[0][0]], [x for x in runs if not x[0][0]]
    prose = [x for x in theirs if x[0][1].endswith((".", "!", "?")) or not x[0][1][:1].isupper()]  # a title after a side list would be an entry of it
    for _ in range(mixed):
        page: list[tuple[bool, str]] = [*r.choice(theirs)] if r.random() < 0.6 else []
        for _ in range(r.randint(3, 8)):
            kind = r.random()
            page += r.choice(ours) if kind < 0.4 else [(True, menu(r))] if kind < 0.5 else [(False, row(r)) for _ in range(r.randint(1, 4))] if kind < 0.56 else [(bad, spoiled(r, line)) for bad, line in r.choice(prose)]
        known.append(page)
    return [p for p in known if p]
