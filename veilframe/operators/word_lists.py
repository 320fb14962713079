"""The built-in word lists for PERSON, LOCATION, NRP and TITLE (English)."""

GIVEN_NAMES = (
    "Alice Amanda Amy Andrea Andrew Angela Ann Anna Anthony Barbara Benjamin Betty Brandon Brian "
    "Carol Catherine Charles Christine Christopher Daniel David Deborah Dennis Diane Donald Donna "
    "Dorothy Edward Elizabeth Emily Emma Eric Evelyn Frank Gary George Gregory Hannah Heather "
    "Helen Henry Jack Jacob James Janet Jason Jeffrey Jennifer Jeremy Jessica John Jonathan Jose "
    "Joseph Joshua Joyce Julia Julie Justin Karen Katherine Kathleen Keith Kelly Kenneth Kevin "
    "Kimberly Larry Laura Lauren Linda Lisa Margaret Maria Marie Martha Mary Matthew Megan Melissa "
    "Michael Michelle Nancy Natalie Nathan Nicholas Nicole Olivia Pamela Patricia Patrick Paul "
    "Peter Rachel Raymond Rebecca Richard Robert Roger Ronald Ruth Ryan Samantha Samuel Sandra "
    "Sara Sarah Scott Sharon Shirley Sophia Stephanie Stephen Steven Susan Teresa Theresa Thomas "
    "Timothy Tyler Victoria Virginia Walter William Zachary"
).split()

LOCATIONS = (
    "Africa|Amsterdam|Argentina|Asia|Athens|Atlanta|Australia|Austria|Baltimore|Bangkok|Beijing|"
    "Belgium|Berlin|Boston|Brazil|Brussels|Cairo|California|Canada|Chicago|China|Colombia|Colorado|"
    "Copenhagen|Dallas|Delhi|Denmark|Denver|Detroit|Dublin|Egypt|England|Europe|Finland|Florida|"
    "France|Geneva|Germany|Greece|Helsinki|Hong Kong|Houston|India|Indonesia|Ireland|Israel|"
    "Istanbul|Italy|Japan|Kenya|Lisbon|London|Los Angeles|Madrid|Melbourne|Mexico|Mexico City|Miami|"
    "Milan|Montreal|Moscow|Mumbai|Munich|Netherlands|New York|New Zealand|Nigeria|Norway|Oslo|"
    "Paris|Peru|Philadelphia|Poland|Portugal|Prague|Rome|Russia|San Diego|San Francisco|Scotland|"
    "Seattle|Shanghai|Singapore|South Africa|Spain|Springfield|Stockholm|Sweden|Switzerland|Sydney|"
    "Texas|Tokyo|Toronto|Turkey|Ukraine|United Kingdom|United States|Vancouver|Vienna|Vietnam|"
    "Wales|Warsaw|Washington|Zurich"
).split("|")

NATIONAL_RELIGIOUS_POLITICAL = (
    "African|American|Anglican|Argentinian|Asian|Australian|Austrian|Belgian|Brazilian|British|"
    "Buddhist|Canadian|Catholic|Chinese|Christian|Colombian|Communist|Conservative|Danish|Democrat|"
    "Dutch|Egyptian|European|Finnish|French|German|Greek|Hindu|Indian|Indonesian|Irish|Israeli|"
    "Italian|Japanese|Jewish|Kenyan|Korean|Lutheran|Mexican|Muslim|Nigerian|Norwegian|Orthodox|"
    "Polish|Portuguese|Protestant|Republican|Russian|Scottish|Sikh|Socialist|Spanish|Swedish|Swiss|"
    "Turkish|Ukrainian|Vietnamese|Welsh"
).split("|")

TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof")
