"""URL filter: rules by host and path, then logistic regression on hashed character n-grams of host and path.

The longest rule that fits decides; a url that no rule fits gets the verdict of a logistic regression, trained here from a
small url table labelled by hand, on hashed character n-grams: 3 to 6 bytes of the words (runs of letters and digits) of host and path,
with marks for a word's ends, so ``bet`` and ``better`` differ.  N-grams of the host and of the path have buckets of their own, so a
word can count in the one and not in the other (a clinic may write about pills).  Each side's n-grams are divided by the root of
their number, so a long path doesn't drown its host, and the path counts half.  Four of five rows of the table are learnt from
(:data:`LABELLED`), those with crc32(url) mod 5 = 0 are held out (:func:`held_out`); :func:`measure` gives precision and recall
there, or over all five folds.

N-grams are hashed for a whole batch at a time in numpy, and urls that a rule decides aren't scored.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the regression's verdict on
an empty url (allow); very long urls count whole; every row is judged by itself, repeated rows too; extra columns pass through
:func:`judged` and :func:`drop_blocked`, whatever their names (the operator's own columns take a free name); an empty table
gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import textscan as S
from .shared import free_names

#: (verdict, rule): a rule's host ends at its first slash; the rest is the path it must begin with.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The labelled urls, written by hand; stems such as bet, win, ads, farm, track, crack or free stand on both sides.
BLOCKED = """
https://lucky-casino.com/slots/bonus
http://www.casinoroyal777.example.com/free-spins
https://play.mega-casino-online.net/register?aff=12
http://casinowinners.click/jackpot/today.php
https://m.live-casino.bet/roulette/en
http://bet-and-win.org/odds/football
https://www.betking247.com/sports/live
http://freebets-daily.example.org/promo/welcome
https://sportsbets.win/tips/sure-wins
http://best-bet-bonus.co.uk/index.php?ref=44
https://poker-stars-free.com/download/app
http://www.onlinepoker.freehost.net/tables/high-stakes
https://texas-poker-cash.com/join
http://jackpot-slots.example.com/spin/now
https://slots-heaven.net/games/777
http://www.vegas-slots-free.click/win/big
https://winbig-lottery.org/claim/prize
http://lottery-winner-claim.com/your/prize
https://gambling-cash.example.org/en/start
http://www.bingo-bonus-win.click/deal
https://cheap-viagra.co.uk/order
http://www.viagra-online-pharmacy.com/buy/now
https://buy-cheap-pills.freehost.net/no-prescription
http://pills4you.com/weight-loss/diet-pills
https://www.cheapmeds-pharma.example.com/cart/add
http://discount-pills-shop.net/xanax
https://diet-pills-miracle.top/lose-weight-fast
http://generic-cialis.org/cheap/tabs
https://www.canadian-pills-rx.com/tramadol
http://cheap-steroids-rx.example.org/order/pills
https://xxx-tube.example/videos/new
http://www.free-porn-cams.co.uk/live/girls
https://adult-dating-now.com/join/free
http://hot-adult-chat.freehost.net/cam/18
https://www.sexcams-live.com/model/anna
http://porn-hd-videos.example.com/watch/12345
https://adult-x-movies.net/category/milf
http://nude-girls-cam.site/enter
https://escort-adult-ads.org/city/berlin
http://www.xxx-adult-pics.com/gallery/9
https://ads.track-click.example.org/r?id=991
http://adserver.banner-net.top/serve/js
https://click.ads-tracker.co.uk/c/8812
http://track.adclicks.com/pixel.gif
https://popads-network.freehost.net/pop/under
http://www.ad-track-server.com/imp?z=3
https://banner-ads-exchange.example.com/rotate/7
http://adsrv.tracking-pixel.net/t.gif
https://ads-media-push.site/notify/allow
http://push-ads.org/subscribe/now
https://spam-mailer-pro.com/bulk
http://www.linkfarm-seo.example.org/links/page9
https://seo-spam-links.site/buy/backlinks
http://cheap-backlinks-farm.co.uk/order
https://article-spam.com/auto/content
http://link-farm-network.freehost.net/dir/a
https://www.spamhub.com/lists/emails
http://buy-followers-cheap.example.com/instagram
https://fake-reviews-farm.net/amazon
http://traffic-bot-seo.info/hits/10000
https://free-iphone-winner.org/claim
http://www.you-won-prize.com/gift/card
https://free-gift-cards.example.org/survey
http://claim-your-prize-now.win/lucky
https://survey-rewards-free.co.uk/step1
http://get-rich-fast.com/secret/method
https://make-money-home.freehost.net/join/free
http://crypto-doubler.com/send/btc
https://bitcoin-profit-bot.example.com/start
http://www.forex-easy-cash.net/signup
https://payday-loans-fast.example/apply
http://cheap-loans-now.org/bad-credit
https://www.instant-cash-loans.com/form
http://no-credit-check-loan.example.org/apply
https://quick-cash-advance.win/step/2
http://debt-relief-loans.co.uk/offer
https://paypal-login-verify.com/account
http://secure-bank-login.freehost.net/update/password
https://www.appleid-verify-account.com/signin
http://netflix-billing-update.example.com/login
https://account-verify-secure.net/confirm/card
http://microsoft-login-alert.win/password/reset
https://warez-cracks.org/download/keygen
http://www.free-crack-software.com/serial/key
https://full-movies-torrent.example.org/free/download
http://keygen-crack-hub.click/photoshop
https://torrent-warez.co.uk/top/100
http://cracked-apps-free.com/apk/mod
https://nulled-scripts.freehost.net/warez/php
http://hack-tools-free.com/password/cracker
https://replica-watches-cheap.example.com/rolex
http://www.fake-rolex-shop.net/buy/cheap
https://cheap-handbags-replica.click/gucci
http://outlet-cheap-shoes.org/nike/sale
http://royal-flush-casino.com/play
https://casino-en-ligne.example.net/bonus
http://bestcasino.online/reviews/slots
https://www.casino777.win/spin
http://goldencasino.example.com/en/lobby
https://mycasinobonus.info/free-spins/today
http://crypto-casino.io/deposit
https://casinos-of-vegas.click/welcome
http://grandcasino-slots.top/
https://vip.casino-palace.site/en/12
http://betmaster365.com/live
https://www.bet-now.online/football
http://superbet.win/odds
https://sure-bets.info/tips/8812
http://betfast.example.org/login
https://dailybets.top/en/44
http://football-betting-tips.site/today
https://bettingodds.click/premier
http://online-betting.example.com/join
https://horse-bets.win/races
http://livebets.online/cricket
https://esports-bet.com/cs/odds
http://free-bet-offers.net/claim
https://bet-bonus.site/100
http://poker-night-cash.com/tables
https://pokerfreeroll.online/register
http://win-at-poker.site/strategy/buy
https://realmoneypoker.top/download
http://hotslots.click/777
https://megaslots.win/jackpots
http://slots-for-cash.com/play
https://free-slots-games.online/spin
http://slotmachine-bonus.info/en/3
https://jackpot-city-win.com/big
http://jackpots4u.click/now
https://megajackpot.example.org/claim
http://roulette-system.site/buy
https://blackjack-cash.online/play
http://lotto-jackpot.win/tickets
https://lottery-results-winner.click/you
http://eurolottery-claim.com/form
https://gamblingsite.example.com/top10
http://gamble-now.online/
https://online-gambling.info/en/9
http://bingo-cash.win/rooms
https://scratchcards-win.com/play
http://cheap-viagra-pills.com/order
https://viagra4less.online/buy
http://generic-cialis.info/price
https://cialis-without-prescription.site/cart
http://canadian-pharma-meds.com/shop
https://rx-meds-online.click/order
http://buy-xanax.online/overnight
https://tramadol-shop.top/buy
http://no-prescription-meds.com/cart
https://cheap-meds.example.com/checkout
http://cheap-pills.online/en/77
https://diet-pills-fast.site/buy
http://slimming-pills.win/offer
https://weightloss-miracle.click/now
http://miracle-keto-pills.com/order
https://steroids-shop.online/muscle
http://buy-steroids.example.net/cart
https://enlargement-pills.top/
http://testosterone-pills.click/buy
https://opioids-for-sale.com/list
http://sexy-girls-cams.com/live
https://sexcams.online/rooms
http://free-sex-videos.click/watch
https://sexshow.example.com/en/5
http://adult-videos.top/new
https://adultcams.site/live
http://xadult.online/enter
https://adult-dating.click/join
http://www.adult-movies.example.org/watch
https://xxx-tube.com/video/881
http://xxxvideos.click/hot
https://freexxx.online/en/1
http://hotxxx.site/gallery
https://porn-tube.online/watch
http://freeporn.example.com/video
https://pornvideos.top/hd
http://teenporn-blocked.click/x
https://nude-celebs.site/gallery
http://nudes.click/today
https://nude-cams.example.net/live
http://live-camgirls.com/chat
https://camgirls.online/top
http://hotcams.site/girls
https://escort-girls.click/city
http://escorts-london.example.com/book
https://vip-escorts.top/en/2
http://hookup-tonight.com/near-you
https://hookups.online/join
http://one-night-dating.site/meet
https://milf-dating.click/now
http://sugar-daddy-hookup.com/profile
https://adserver.example.com/banner/12
http://ads.doubleserve.net/click
https://ads-network.io/imp
http://adtrack.example.net/pixel
https://ad-tracker.online/px.gif
http://track-clicks.com/redirect
https://clicktrack.site/r/88
http://popads.example.org/pop
https://popunder-ads.click/serve
http://banner-ads.top/728x90
https://adbanners.info/serve
http://ads-delivery.win/slot/3
https://adclicks.online/go
http://promo-ads.site/out
https://smartads.example.com/rtb
http://tracking-pixel.click/p
https://ads4site.com/js
http://bannerexchange.site/click
https://spam-mailer.com/buy
http://bulk-spam.online/send
https://spamfarm.top/links
http://link-farm.example.com/page/4
https://linkfarm.click/out
http://buy-backlinks.site/packages
https://cheap-backlinks.online/seo
http://backlinks4seo.com/order
https://seo-farm.top/articles
http://article-spinner-spam.click/12
https://free-traffic-bot.site/start
http://buy-followers.online/instagram
https://followers4cheap.com/order
http://likes-and-followers.click/buy
https://fake-reviews.site/order
http://mass-mailer.example.net/spam
https://payday-loans-now.com/apply
http://instant-payday.online/cash
https://fastcash-loans.site/approve
http://quick-cash-loan.click/apply
https://badcredit-loans.top/now
http://easy-loans-no-check.com/form
https://cash-advance-fast.online/start
http://get-rich-quick.site/system
https://getrich.online/now
http://double-your-bitcoin.com/send
https://bitcoin-doubler.click/invest
http://crypto-giveaway.win/elon
https://btc-doubler.top/start
http://free-bitcoin-generator.site/run
https://forex-profit-robot.com/buy
http://forex-signals-profit.online/join
https://binary-options-profit.click/
http://hyip-profit.top/invest
https://make-money-fast.example.org/start
http://work-from-home-cash.site/join
https://free-iphone-winner.click/claim
http://you-are-a-winner.win/prize
https://claim-your-prize.online/form
http://prize-winner.site/congratulations
https://free-giftcards.click/generator
http://giftcard-generator.online/amazon
https://win-free-prizes.com/enter
http://free-prize-draw.top/now
https://congratulations-winner.click/
http://walmart-giftcard-free.site/claim
https://paypal-login-verify.com/account
http://verify-account-login.online/bank
https://login-alert-bank.click/secure
http://secure-verify-login.top/update
https://appleid-verify.site/unlock
http://account-suspended-verify.click/id
https://bank-login-alert.example.net/form
http://update-your-billing-login.online/pay
https://netflix-login-verify.site/card
http://wallet-verify.click/seed
https://free-cracks.com/download
http://software-crack.online/photoshop
https://crack-keygen.site/office
http://keygens.click/serial
https://serial-keygen.top/windows
http://warez-download.online/apps
https://warezworld.com/new
http://nulled-scripts.site/themes
https://nulled-plugins.click/wp
http://torrent-movies-free.online/hd
https://free-torrents.site/top
http://hacked-accounts.click/list
https://hack-facebook-password.online/go
http://game-hacks.top/aimbot
https://free-hacks.site/robux
http://botnet-rental.click/order
https://ddos-for-hire.top/pay
http://carding-shop.online/cc
https://fake-rolex.site/buy
http://replica-watches.online/rolex
https://cheap-replica-bags.click/gucci
http://replica-shoes.top/nike
https://discount-rolex.example.com/cart
http://fake-id-shop.online/order
https://free-vbucks.click/generator
http://cheap-followers-bot.site/run
""".split()

ALLOWED = """
https://www.stonebridge-library.org/catalogue/history
http://library.northfield.edu/search?q=maps
https://university.edu/research/paper.html
http://www.physics.westlake.edu/people/staff
https://college-of-arts.edu/courses/2024/painting
http://school.info/timetable/monday
https://www.city-council.gov/services/water
http://parks.gov/trails/map.pdf
https://health.gov/vaccines/children
http://www.weather-service.gov/forecast/berlin
https://news.dailyherald.com/politics/election-results
http://www.morning-post.com/world/2023/05/12
https://times-journal.site/opinion/editorial
http://radio-north.org/programmes/evening
https://blog.gardeners-world.org/roses/pruning
http://blog.mountain-hikes.top/alps/day-3
https://www.bakery-corner.com/recipes/sourdough
http://cooking.net/soup/lentil.html
https://family-recipes.online/desserts/apple-pie
http://knitting-patterns.win/socks/winter
https://docs.openparser.org/en/latest/api.html
http://docs.datatools.info/guide/install
https://github-like.dev/project/readme
http://www.linux-handbook.com/shell/loops
https://python-notes.site/lists/sorting
http://wiki.example.org/index/Photosynthesis
https://encyclopedia.org/de/Goethe
http://www.dictionary-online.top/word/serendipity
https://museum-of-science.org/exhibitions/space
http://art-gallery.net/artists/impressionists
https://www.railway-timetables.online/stations/york
http://trains.win/tickets/return
https://bike-repair.org/brakes/adjust
http://carparts-store.info/filters/oil
https://www.bookshop-lane.com/fiction/new
http://toystore.com/puzzles/wooden
https://furniture-house.site/tables/oak
http://shop.teahouse.com/green/sencha
https://www.organic-farm.org/vegetables/box
http://dairy-farm-visits.top/kids/cheese
https://farmers-market.net/opening/hours
http://weather.net/today
https://maps.online/route/home
http://m.example.com/1234
https://example.org/
http://example.com/en/77
https://x.example.net/fr/5
http://a.org/b
https://forum.woodworkers.win/thread/8812
http://forum.astronomy-club.org/telescopes/91
https://community.chess.info/openings/sicilian
http://chess-club.net/tournament/winners
https://www.football-league.com/results/winners-cup
http://athletics.site/records/win-times
https://swimming-school.com/lessons/free-trial
http://freedom-of-information.org/requests
https://free-university.edu/lectures/law
http://www.freemusic-archive.top/classical/bach
https://children-hospital.org/visit/parking
http://dentist-berlin.net/appointments
https://www.pharmacy-museum.online/history/jars
http://clinic-north.win/patients/medication-pills
https://nurses-journal.com/articles/pain-relief
http://medicine.edu/papers/cialis-trial
https://addiction-help.info/gambling/casino-losses
http://www.gambling-research.edu/papers/online-casino
https://policy-institute.org/reports/betting-law
http://news.com/economy/poker-champion-tax
https://www.court-records.gov/cases/spam-ruling
http://security-blog.site/phishing/login-pages
https://internet-safety.org/parents/adult-content
http://adult-education.org/evening/classes
https://www.adult-literacy.gov/courses/reading
http://consumer-advice.gov/loans/payday-warning
https://bank-museum.top/history/coins
http://www.savings-bank.com/branches/map
https://credit-union.net/members/meeting
http://insurance-guide.online/home/contents
https://tracking-wolves.win/field/notes
http://running-track.com/events/relay
https://parcel-service.info/track/help
http://advertising-history.edu/posters/1920
https://addresses.example.gov/postcodes
http://www.madrid-guide.com/museums/prado
https://shadow-theatre.com/plays/spring
http://roadside-cafe.site/menu/breakfast
https://betty-smith-author.com/novels
http://alphabet-games.org/kids/letters
https://winter-sports.top/ski/wax
http://windmill-trust.org/visit
https://www.twin-cities-choir.net/concerts
http://spinach-growers.online/soil/ph
https://sussex-walks.win/coast/path
http://essex-county.gov/council/minutes
https://middlesex.edu/admissions/dates
http://spamalot-theatre.com/tickets
https://linkoping-city.info/tourism
http://pillsbury-house.org/tours
https://cash-museum.edu/numismatics
http://health-tracker.org/steps
https://bug-tracker.example.com/issues/12
http://flight-tracker.net/arrivals
https://fitness-tracker-reviews.com/watches
http://storm-tracker.gov/radar
https://package-tracking.example.net/post
http://race-track-history.com/laps
https://tracks-and-trails.org/maps
http://track-and-field.info/records
https://soundtrack-library.com/films
http://parking-lots.com/city
https://pilots-association.org/training
http://ballots-and-elections.gov/results
https://time-slots-booking.com/dentist
http://plots-and-gardens.org.uk/allotments
https://zealots-in-history.edu/essays
http://ocelots-conservation.org/sightings
https://cashmere-wool.com/sweaters
http://cashew-recipes.net/curry
https://cashflow-accounting.edu/course
http://johnny-cash-songs.com/lyrics
https://crackers-bakery.com/cheese
http://nutcracker-ballet.org/tickets
https://firecracker-safety.gov/rules
http://cracking-concrete-repair.com/guide
https://nutcrackers.info/wood
http://winnersh-school.co.uk/terms
https://windows-repair.com/glass
http://winter-gardens.org/visit
https://darwin-museum.edu/voyage
http://edwin-morgan-poetry.org/works
https://twins-clinic.org/care
http://wineries-of-spain.com/rioja
https://wing-and-feather.net/birds
http://godwin-papers.edu/letters
https://swindon-library.org.uk/hours
http://winding-river-inn.com/rooms
https://adobe.com/products
http://freedesktop.org/wiki
https://freebsd.org/handbook
http://freedom-of-information.gov/requests
https://smoke-free-homes.org/advice
http://gluten-free-bakery.com/bread
https://free-software-society.org/licences
http://freeman-history.edu/archive
https://carefree-camping.com/sites
http://tax-free-allowance.gov/savings
https://barrier-free-travel.org/guides
http://cameras-review.com/lenses
https://cambridge-press.org/journals
http://campus-maps.edu/buildings
https://camping-equipment.com/tents
http://camden-market.info/stalls
https://camels-and-deserts.org/facts
http://webcam-weather.net/mountain
https://cameroon-travel.info/yaounde
http://scams-awareness.gov/report
https://profit-and-loss-accounting.edu/lesson
http://nonprofit-directory.org/charities
https://profits-economics.edu/lectures
http://alphabet-songs.com/kids
https://diabetes-care.org/diet
http://elizabeth-gaskell.org/novels
https://bethlehem-steel-history.org/plants
http://better-sleep.info/tips
https://tibet-travel.org/lhasa
http://betony-herbs.com/seeds
https://gibbet-hill.info/walks
http://sherbet-recipes.com/lemon
https://diabetic-recipes.net/soup
http://caterpillars-uk.info/species
https://pillars-of-rome.edu/forum
http://oil-spills-response.gov/training
https://pillow-shop.com/feather
http://pillsbury-baking.com/cakes
https://spillway-engineering.edu/dams
http://adult-learning.edu/courses
https://adult-nursing.org/careers
http://young-adult-fiction.com/reviews
https://adults-swimming-lessons.co.uk/times
http://essex-history.org/castles
https://sussex-beekeepers.org/honey
http://wessex-archaeology.co.uk/digs
https://sextant-navigation.com/history
http://middlesex-cricket.info/scores
https://unisex-barbers.com/prices
http://sexagesimal-numbers.edu/babylon
https://organic-farm.com/vegetables
http://wind-farm-engineering.edu/turbines
https://farm-machinery.net/tractors
http://farmers-market.org/saturday
https://dairy-farmers.info/milk
http://pharmacology-journal.edu/issues
https://pharmacy-school.edu/admissions
http://pharmaceutical-history.org/museum
https://hospital-pharmacy.org/hours
http://medieval-history.edu/castles
https://meds-safety.gov/storage
http://medals-and-coins.com/catalogue
https://hackney-council.gov/bins
http://hackathon-students.edu/teams
https://thackeray-letters.org/1850
http://shack-on-the-beach.com/menu
https://whack-a-mole-toys.com/shop
http://hacksaw-tools.com/blades
https://seoul-city-guide.com/palaces
http://museo-del-prado.es/obras
https://paseo-marina.es/hoteles
http://nobelprize-physics.org/laureates
https://booker-prize-books.com/shortlist
http://enterprise-software.com/erp
https://surprise-party-ideas.com/cakes
http://prize-giving-school.org/photos
https://torrential-rain-warnings.gov/today
http://torrents-of-the-alps.org/hydrology
https://carbon-dating-lab.edu/method
http://updating-python.org/howto
https://dating-of-manuscripts.edu/palaeography
http://consolidating-archives.org/index
https://heritage-lottery-museum.org/grants
http://lottery-of-birth-essay.edu/ethics
https://bicycle-spokes.com/wheels
http://pokeweed-botany.edu/plants
https://stokers-of-titanic.org/crew
http://bonuses-and-salaries.gov/statistics
https://bonsai-and-pots.com/maples
http://bannerman-castle.org/tours
https://banner-making-workshop.org/felt
http://heraldry-banners.edu/lions
https://popup-books.com/children
http://pop-music-archive.org/1965
https://escorted-tours-italy.com/rome
http://ford-escort-club.org.uk/meet
https://naval-escort-ships.edu/convoys
http://replica-ships-museum.org/vasa
https://fossil-replicas-school.com/casts
http://replication-in-databases.edu/raft
https://miracle-plays-york.org/cycle
http://miracle-on-ice-history.com/1980
https://student-loans.gov/repay
http://bank-loans-explained.org/interest
https://library-loans.edu/renew
http://loan-words-in-english.edu/french
https://sloane-collection.org/plants
http://loanhead-primary-school.org.uk/news
https://clickstream-analytics.edu/course
http://clicks-and-bricks-retail.com/essay
https://click-beetles.info/species
http://forest-exploration.org/trails
https://for-example-grammar.com/lessons
http://foreign-exchange-students.org/host
https://verification-of-models.edu/theorem
http://login-help.university.edu/password
https://single-sign-on.example.com/docs
http://account-books-1700.org/ledger
https://spam-filter-research.edu/papers
http://spam-canned-meat-museum.com/visit
https://seo-yun-piano.com/concerts
http://backlink-free-wiki.org/about
https://followers-of-mozart.org/society
http://followers-of-fashion-1800.com/prints
https://ads-b-aviation.edu/receivers
http://adsorption-chemistry.edu/surfaces
https://roads-and-bridges.gov/works
http://uploads-api.example.com/docs
https://beads-and-jewellery.com/patterns
http://heads-of-state.info/list
https://threads-and-needles.com/sewing
http://shadows-photography.com/gallery
https://loads-and-beams.edu/tables
http://gladstone-library.org/readers
https://madison-county.gov/permits
http://broadcast-history.org/radio
https://salads-and-soups.com/spring
http://trading-standards.gov/complaints
https://grading-essays.edu/rubric
http://reading-rooms.org/hours
https://casinos-architecture-history.edu/monaco
http://monte-carlo-methods.edu/sampling
https://poker-chips-of-the-west-museum.org/1880
http://roulette-of-cycloids.edu/curves
https://game-theory.edu/nash
http://gamblers-helpline.gov/support
https://problem-gambling-advice.org/help
http://blackjack-oak-trees.org/leaves
https://jackpot-nevada-town.gov/meetings
http://jackdaws-and-rooks.org/nests
https://jackets-and-coats.com/wool
http://bingo-wings-exercise.com/arms
https://bingham-canyon.org/geology
http://viaggi-in-italia.it/toscana
https://niagara-falls-guide.com/boat
http://via-appia.org/walks
https://specialist-doctors.org/find
http://socialist-history.edu/1848
https://commercialism-essay.edu/art
http://xanadu-poem.org/coleridge
https://xxi-century-art.org/rooms
http://super-bowl-xxx-history.com/teams
https://popcorn-recipes.com/caramel
http://corn-and-maize.org/fields
https://nude-in-art-history.edu/rubens
http://denuded-hills-ecology.org/soil
https://crypto-museum.nl/enigma
http://cryptography-lectures.edu/rsa
https://bitcoin-whitepaper-study.edu/notes
http://gift-wrapping-ideas.com/paper
https://giftcards-school-fundraiser.org/about
http://gifted-children.org/lessons
https://weight-training.org/plans
http://weights-and-measures.gov/scales
https://keto-clinical-trials.edu/results
http://steroid-hormones.edu/biochemistry
https://opioid-crisis.gov/data
http://drug-safety.gov/alerts
https://xray-crystallography.edu/proteins
http://double-glazing.com/quotes
https://doubler-circuits.edu/voltage
http://quick-bread-recipes.net/banana
https://fast-rail-network.org/stations
http://cheapside-history.org/1666
https://discount-rail-cards.gov/young
http://buy-local-produce.org/shops
https://order-of-operations.edu/maths
http://claim-child-benefit.gov/form
https://winners-of-the-tour.com/1985
http://winner-takes-all-voting.edu/systems
https://watch-repair.com/springs
http://watches-and-clocks-museum.org/rooms
https://live-music-venues.com/jazz
http://hot-springs-iceland.com/pools
https://girls-school-history.org/1890
http://tube-maps.org/london
https://video-editing-course.edu/week1
""".split()

LABELLED = tuple([(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED])
LEAST, MOST, BITS = 3, 6, 18
#: How much a path counts beside its host.
PATH_SHARE = 0.5
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def held_out(url: str, fold: int = 0) -> bool:
    """Whether a row of the labelled table is kept for measuring; other folds than the first are for cross-validation."""
    return zlib.crc32(url.encode()) % 5 == fold


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, as the module's SQL form gives them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut]


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all urls of a batch: buckets of their n-grams, which url each belongs to, and its share."""
    found = []
    for side, col in enumerate((hosts, paths)):
        buf, offs = S.raw(col)
        buf = S.LOWER[buf]
        starts, ends = S.runs(ALNUM[buf], offs)
        grams, begin = S.ngrams(buf, starts, ends, LEAST, MOST, BITS - 1)
        owner = np.repeat(S.owners(starts, offs), np.diff(begin))
        count = np.bincount(owner, minlength=len(offs) - 1)
        found.append((grams + (side << (BITS - 1)), owner, (PATH_SHARE if side else 1.0) / np.sqrt(count[owner])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def columns(urls: list[str]) -> tuple[pa.Array, pa.Array]:
    parts = [split_url(u) for u in urls]
    return pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string())


class Model:
    """One weight for each bucket, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def logits(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        grams, owner, share = features(hosts, paths)
        return np.bincount(owner, weights=self.weights[grams] * share, minlength=len(hosts)) + self.bias


def fit(labelled=LABELLED, epochs: int = 300, rate: float = 60.0, decay: float = 1e-5, fold: int = 0) -> Model:
    """Logistic regression by full-batch gradient descent over the rows that aren't held out; rows are weighed so that both
    classes count alike.  Without rows of both classes every verdict is to allow."""
    rows = [(u, v) for u, v in labelled if not held_out(u, fold)]
    y = np.array([v for _, v in rows], float)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(1 << BITS), -1.0)
    grams, owner, share = features(*columns([u for u, _ in rows]))
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(epochs):
        z = np.bincount(owner, weights=w[grams] * share, minlength=len(y)) + b
        err = (1 / (1 + np.exp(-z)) - y) * each
        w -= rate * (np.bincount(grams, weights=err[owner] * share, minlength=1 << BITS) + decay * w)
        b -= 0.1 * rate * err.sum()
    return Model(w, min(b, -0.01))


def measure(labelled=LABELLED, folds: tuple[int, ...] = (0,)) -> tuple[float, float]:
    """Precision and recall of blocking on rows that weren't learnt from, of one fold or of several, each with its own model."""
    said, y = [], []
    for fold in folds:
        rows = [(u, v) for u, v in labelled if held_out(u, fold)]
        said += list(fit(labelled, fold=fold).logits(*columns([u for u, _ in rows])) > 0)
        y += [v == 1 for _, v in rows]
    hits = sum(a and b for a, b in zip(said, y, strict=True))
    return hits / max(1, sum(said)), hits / max(1, sum(y))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; the rules become one expression."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        this = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, this) if out is None else out.when(fits, this)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def judged(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """All columns of pages, with __host, __path, __rule and __verdict last (each with ``_`` behind it where pages has the name)."""
    sent = pages.sparkSession.sparkContext.broadcast(fit(labelled))  # 2**BITS numbers
    url, host, path, found, score = free_names(pages.columns, "__url", "__host", "__path", "__found", "__score")
    names = free_names(pages.columns, "__host", "__path", "__rule", "__verdict")

    @F.pandas_udf("double")
    def logit(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        """Null where the host is: a rule has decided."""
        out = np.full(len(hosts), np.nan)
        asked = np.flatnonzero(hosts.notna().to_numpy())
        if len(asked):
            out[asked] = sent.value.logits(pa.array(hosts.iloc[asked], pa.string()), pa.array(paths.iloc[asked], pa.string()))
        return pd.Series(out)

    parts = pages.withColumn(url, F.coalesce(F.col("url"), F.lit("")))
    rest = F.expr(f"case when instr(`{url}`, '://') > 0 then substr(`{url}`, instr(`{url}`, '://') + 3) else '' end")
    low = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = parts.withColumns({host: low, path: F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})
    parts = parts.withColumn(found, matching_rule(F.col(host), F.col(path), rules))
    parts = parts.withColumn(score, logit(*[F.when(F.col(found).isNull(), F.col(c)) for c in (host, path)]))
    verdict = F.coalesce(F.col(f"{found}.verdict"), F.when(F.col(score) > 0, "block").otherwise("allow"))
    own = (F.col(host), F.col(path), F.col(f"{found}.rule"), verdict)
    return parts.select(*pages.columns, *[c.alias(n) for c, n in zip(own, names, strict=True)])


def drop_blocked(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """The rows of pages that are allowed, with their own columns."""
    out = judged(pages, rules, labelled)
    return out.where(F.col(out.columns[-1]) == "allow").select(*pages.columns)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages).select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))
