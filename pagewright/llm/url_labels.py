"""A small labelled table of URLs: unwanted (1) and ordinary (0), each with the word that tells what it is.

Written by hand for this module, after the categories that public block lists use: gambling, medicines, adult, loans, false
goods, piracy, trackers, harmful downloads, link spam. Hosts are made up and none is taken from a table that queries run
on. The word is what a held-out test leaves out whole: all rows of a word are on one side of a split.
"""

from __future__ import annotations

import numpy as np

UNWANTED = """
casino    royal-casino-club.top/slots/spin        casino    www.vegascasino24.bet/bonus
casino    mobile.luckycasino.win/register         poker     online-poker-room.bet/tables
poker     poker-freeroll.club/join/now            roulette  roulette-king.win/live
roulette  playroulette.top/spin?ref=8812          slots     777slots.bet/jackpot
slots     mega-slots-free.xyz/play                jackpot   dailyjackpot.win/claim
jackpot   jackpot-city-bonus.top/en/claim         bingo     bingo-bonanza.bet/tickets
betting   sports-betting-tips.top/odds            betting   bet365-mirror.xyz/login
betting   freebet-today.win/odds/football         lottery   lottery-winner-notice.xyz/claim
lottery   euro-lottery.win/prize/9931             viagra    buy-viagra-now.top/order
viagra    www.viagra-without-prescription.shop/cart   cialis  cialis20mg.xyz/buy
cialis    generic-cialis-store.top/cheap          tramadol  tramadol-online-pharmacy.top/order
pharmacy  rx-pharmacy-discount.shop/pills         pharmacy  noscript-pharmacy.xyz/cart
pills     diet-pills-direct.shop/offer            pills     sleepingpills.top/buy?x=2
pills     male-enhancement-pills.xyz/trial        steroids  steroids4sale.shop/cart
xxx       hot-xxx-videos.cam/watch                xxx       freexxxtube.top/watch/1173
porn      pornstars-live.cam/room                 porn      best-free-porn.xyz/clips
sex       sexdating-tonight.cam/meet              sex       adult-sex-chat.top/room/5
nude      nude-webcams.cam/live                   escort    escort-girls-city.top/profiles
camgirls  camgirls4you.cam/tokens                 dating    hookup-dating.xyz/signup
loan      payday-loan-instant.top/apply           loan      badcredit-loans.xyz/apply-now
loan      cashloan24.shop/approve                 payday    paydayadvance.top/cash
credit    free-credit-score-fix.xyz/now           cash      fast-cash-home.top/earn
cash      make-cash-online.xyz/secret             crypto    crypto-doubler.xyz/invest
crypto    bitcoin-crypto-giveaway.top/claim       forex     forex-robot-profit.shop/trial
invest    guaranteed-invest-return.top/plan       income    passive-income-trick.xyz/video
replica   replica-watches-outlet.shop/rolex       replica   luxury-replica-bags.top/sale
outlet    cheap-outlet-jerseys.shop/nike          cheap     cheap-sunglasses-sale.top/buy
cheap     cheapest-handbags.shop/discount         discount  super-discount-meds.xyz/order
warez     warez-underground.top/dl                warez     games-warez.xyz/iso/full
crack     photoshop-crack.top/download            crack     cracked-software.xyz/serial
keygen    keygen-generator.top/download           keygen    office-keygen.xyz/free
torrent   hd-torrent-movies.top/magnet            torrent   torrentleech-free.xyz/get
iptv      iptv-premium-free.xyz/m3u               serial    serial-numbers.top/list
track     click-track.link/r?id=99211             track     pixel-track.net/t.gif
tracker   adtracker.link/collect                  ads       ads-serve.link/banner/728x90
ads       popads-network.link/pop                 banner    banner-exchange.link/show?z=3
popup     popup-traffic.link/under                click     click-rewards.top/go
adserver  adserver-cdn.link/js/ad.js              affiliate affiliate-cash.link/ref/18
phish     secure-login-verify.top/account         phish     paypal-verify-account.xyz/signin
verify    bank-verify-update.top/login            login     appleid-login-locked.xyz/unlock
malware   flash-player-update.xyz/setup.exe       malware   pc-cleaner-free.top/install.exe
update    codec-update-required.top/player.exe    prize     you-won-a-prize.top/iphone
prize     survey-prize-winner.xyz/claim           free      free-gift-cards.xyz/generator
free      freeiphone-today.top/claim              gift      gift-card-generator.xyz/codes
spam      bulk-spam-mailer.top/buy                spam      seo-spam-links.xyz/package
backlinks buy-backlinks-cheap.top/package         traffic   buy-traffic.xyz/visitors
followers buy-followers-now.top/instagram         miner     browser-miner.link/coin.js
farm      link-farm-directory.xyz/submit          scam      lottery-scam-letters.top/x
essay     buy-essay-online.top/order              wonder    weight-loss-wonder.xyz/trial
"""

ORDINARY = """
library    city-library.org/catalogue/search      library    www.nationallibrary.eu/collections/maps
library    library.smalltown.gov/opening-hours    school     hillside-school.edu/term-dates
school     musicschool.org/lessons/piano          university university-press.edu/journals/12
university www.northuniversity.edu/research/physics  college  stmary-college.edu/alumni
museum     maritime-museum.org/exhibitions        museum     museum-of-glass.eu/visit/tickets
archive    stateachive.gov/records/1890           archive    filmarchive.org/restored/list
science    popular-science.net/articles/oceans    science    sciencefestival.org/programme
history    local-history.org/walks/harbour        garden     botanical-garden.org/plants/roses
garden     gardenclub.net/spring/seeds            kitchen    familykitchen.net/recipes/soup
recipe     breadrecipes.net/sourdough/starter     recipe     recipe-notebook.com/cakes/lemon
travel     slowtravel.net/italy/by-train          travel     travelphrases.com/de/greetings
weather    mountainweather.net/forecast/today     weather    weather-station.org/rainfall/2019
news       eveningnews.com/politics/council       news       www.harbournews.net/local/ferry
times      valleytimes.com/sports/results         daily      dailyherald.net/letters/editor
journal    medicaljournal.org/issues/44/3         journal    journal-of-botany.org/abstract/771
blog       knittingblog.net/patterns/scarf        blog       blog.brickworks.com/releases/notes
radio      communityradio.org/schedule            radio      radio-classics.net/concerts
music      chambermusic.org/season/quartets       music      folkmusic.net/songs/archive
film       filmsociety.org/screenings/march       book       bookreviews.net/novels/2021
book       secondhandbooks.com/catalogue/poetry   reader     slowreader.net/essays/walking
writer     writersguild.org/workshops             press      smallpress.org/titles/new
health     publichealth.gov/vaccines/schedule     health     healthyfeet.net/advice/shoes
clinic     riverside-clinic.org/appointments      hospital   childrenshospital.org/wards
doctor     familydoctors.net/practice/team        nurse      nursetraining.edu/courses
family     familytree.net/surnames/miller         house      oldhouse.net/restoration/windows
home       homebuilders.org/members/list          city       citycouncil.gov/minutes/2020
river      rivertrust.org/volunteer/days          mountain   mountainrescue.org/reports
park       nationalparks.gov/trails/lakes         bird       birdwatchers.net/sightings/may
sport      rowingclub.org/regatta/results         football   youthfootball.net/fixtures
chess      chessclub.net/tournaments/rapid        cycling    cyclingroutes.org/coast/map
railway    railwaymodels.net/gauges/n             ferry      islandferry.com/timetable/summer
bus        regionalbus.com/lines/14               airport    smallairport.com/arrivals
market     farmersmarket.org/stalls/honey         shop       bicycleshop.com/repairs/book
bakery     cornerbakery.com/opening               coffee     coffeeroasters.com/beans/ethiopia
bank       savingsbank.com/branches/map           insurance  mutualinsurance.com/claims/form
law        lawreview.edu/volumes/91               court      countycourt.gov/calendar
software   opensoftware.org/docs/install          code       codereview.net/questions/4417
data       opendata.gov/datasets/traffic          docs       docs.printworks.com/api/v2/errors
wiki       gardenwiki.org/pages/compost           forum      woodforum.net/threads/8123
paper      papermill.com/products/envelopes       print      printshop.com/business-cards
church     parishchurch.org/services              charity    foodbank.org/donate/tins
theatre    littletheatre.org/auditions            gallery    artgallery.net/prints/etchings
photo      photoarchive.net/streets/1955          camera     camerarepair.net/lenses
language   languagecafe.org/spanish/monday        teacher    teachersnotes.net/fractions
student    studentunion.edu/societies/list        exam       examboard.org/papers/2018
engineer   engineersweekly.com/bridges            energy     windenergy.org/turbines/offshore
water      watersupply.gov/quality/report         forest     forestry.gov/licences
animal     animalshelter.org/adopt/cats           vet        villagevet.net/advice/dogs
"""

#: Ordinary hosts made of letters that follow each other in the table's ordinary hosts: most names mean nothing.
MADE_UP = 120
#: Each row also stands under an ending of these, the same for both labels: an ending alone tells little.
ENDINGS = (".com", ".org", ".net", ".eu", ".top", ".shop", ".club")


def _rows(text: str, label: int) -> list[tuple[str, str, str, int]]:
    words = text.split()
    rows = []
    for word, url in zip(words[::2], words[1::2], strict=True):
        host, _, path = url.partition("/")
        path = "/" + path.split("?")[0]
        rows.append((word, host, path, label))
        rows.append((word, host.rpartition(".")[0] + ENDINGS[len(rows) // 2 % len(ENDINGS)], path, label))
        front = ("www.", "", "m.", "blog.")[len(rows) // 3 % 4]
        rows.append((word, front + host.removeprefix("www.").rpartition(".")[0] + ENDINGS[len(rows) % 4], f"/{('en', 'de', 'fr', 'es')[len(rows) % 4]}/{len(rows) * 37 % 1000}", label))
    return rows


def _made_up(hosts: list[str]) -> list[tuple[str, str, str, int]]:
    rng = np.random.default_rng(17)
    names = [h.removeprefix("www.").split(".")[0] for h in hosts]
    after: dict[str, list[str]] = {}
    for n in names:
        for a, b in zip(f"^^{n}", f"^{n}$", strict=False):
            after.setdefault(a, []).append(b)
    rows = []
    while len(rows) < MADE_UP:
        name, last = "", "^"
        while last != "$" and len(name) < 14:
            last = str(rng.choice(after[last]))
            name += last.strip("^$")
        if 4 <= len(name) <= 13 and name.strip("-") == name:
            k = len(rows)
            rows.append((f"made-up-{k}", f"{('www.', '', 'm.')[k % 3]}{name}{ENDINGS[k % len(ENDINGS)]}", f"/{('en', 'de', 'fr', 'es', 'docs')[k % 5]}/{int(rng.integers(1, 100_000))}", 0))
    return rows


def table() -> list[tuple[str, str, str, int]]:
    """(word, host, path, label) of each row."""
    ordinary = _rows(ORDINARY, 0)
    return [*_rows(UNWANTED, 1), *ordinary, *_made_up([h for _, h, _, _ in ordinary])]
