"""Word lists, patterns and thresholds that results depend on, in their natural order."""

# fixed values: share trackers in URLs
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "n_media", "n_query", "n_rank", "n_ad_group", "n_ad"]

# fixed values: words of market-wide news
MARKET_SUBJECT = ["코스피", "코스닥", "국내 증시", "국내증시", "뉴욕증시", "나스닥", "다우", "증시"]

MARKET_MOVE = [
    "장중",
    "장초반",
    "장 초반",
    "장전",
    "마감",
    "개장",
    "급락",
    "급등",
    "사이드카",
    "서킷브레이커",
    "패닉",
    "출렁",
    "브리핑",
    "시황",
    "선 회복",
    "선 붕괴",
    "선 돌파",
    "약세",
    "강세",
    "반등",
    "폭락",
    "폭등",
    "하락 마감",
    "상승 마감",
    "하락 출발",
    "상승 출발",
    "순매도",
    "순매수",
]
MARKET_FLOW = [
    "외국인 순매도",
    "외국인 매도",
    "기관 매수",
    "기관 매도",
    "외국인 순매수",
    "프로그램 매매",
]
COMPANY_EVENT = [
    "계약",
    "착공",
    "인수",
    "합병",
    "공급",
    "출시",
    "투자 발표",
    "임단협",
    "임협",
    "파업",
    "수주",
    "지분",
    "실적",
    "신제품",
    "리콜",
    "협약",
    "MOU",
    "특허",
    "증설",
    "공장",
    "배당",
    "자사주",
    "유상증자",
]

# fixed values: patterns of investment information
INFO_PATTERNS = [
    r"인기\s*검색",
    r"데이터랩",
    r"검색\s*(종목|어)",
    r"초고수",
    r"\d+%\s*(초)?고수",
    r"순위",
    r"TOP\s*\d",
    r"상위\s*\d+\s*(종목|선)",
    r"선호(도|\s*종목)",
    r"많이\s*(담|산|매수)",
    r"가장\s*많이",
    r"20選|20선",
    r"(추천|유망|주목|관심|기대)\s*종목",
    r"이\s*(종목|주식)",
    r"살\s*만한",
    r"거래소\s*(외국인|기관|개인)",
    r"(외국인|기관|개인|외인)[^ ]{0,4}\s*(집중\s*)?(순)?(매수|매도)",
    r"집중\s*(매수|매도)",
    r"폭풍\s*(매수|매도)",
    r"차익\s*실현",
    r"포트폴리오",
    r"GPIF|국민연금|연기금",
    r"ADR",
    r"프리(뷰|마켓|장)",
    r"브리핑",
    r"리뷰",
    r"전망(치|은|이|을)?\s*$|전망\b",
    r"특징주",
    r"특징\s*포착",
    r"사자|팔자",
    r"담(고|았|은)",
    r"(샀|팔았)다",
    r"\d+[·\-]\d+\s*(세대|은|대)",
    r"청년\s*세대",
    r"더블배거",
    r"주가[,·\s].*(상승|하락|강세|약세|보합|반등|급등|급락)",
    r"주가[,·\s].*\d+\.?\d*\s*%",
    r"장\s*(중|초반|후반|막판).*(상승|하락|강세|약세|보합|등락|변동)",
    r"\d+\s*거래일.*(상승|하락|반등|약세|강세)",
    r"동적\s*VI|정적\s*VI|변동성\s*완화",
    r"강보합|약보합|보합세",
    r"주가\s*흐름|주가\s*향방|향방은",
    r"[가-힣]+주\s*(전반|일제히|동반|약세|강세|급락|급등|털썩|혼조)",
    r"\d+원선?\s*(회복|이탈|위협|붕괴|돌파|중심)",
    r"만평",
    r"낙수효과",
    r"베이스캠프",
    r"모멘텀",
    r"랠리",
    r"양극화",
    r"[Kk]-?조선|[Kk]-?방산|[Kk]-?주식|[Kk]-?배터리",
    r"빅\s*\d",
    r"업황|업계\s*(전반|동향|판도)",
    r"시험대|재평가|기대감\s*(부각|확산)",
    r"쏠린\s*눈|주목받|주목한다|이목",
    r"남는\s*장사|진짜\s*무기|쫄\s*필요",
]
# Words for each of the patterns above: a text without any of them can't match it.
INFO_WORDS = [
    ("검색",), ("데이터랩",), ("검색",), ("초고수",), ("고수",), ("순위",), ("TOP",), ("상위",), ("선호",), ("많이",), ("가장",), ("20",), ("종목",), ("종목", "주식"),
    ("만한",), ("거래소",), ("매수", "매도"), ("집중",), ("폭풍",), ("실현",), ("포트폴리오",), ("GPIF", "국민연금", "연기금"), ("ADR",), ("프리",), ("브리핑",), ("리뷰",), ("전망",), ("특징주",),
    ("포착",), ("사자", "팔자"), ("담",), ("샀다", "팔았다"), ("은", "대"), ("세대",), ("더블배거",), ("주가",), ("주가",), ("장",), ("거래일",), ("VI", "변동성"), ("보합",), ("주가", "향방은"),
    ("주",), ("원",), ("만평",), ("낙수효과",), ("베이스캠프",), ("모멘텀",), ("랠리",), ("양극화",), ("조선", "방산", "주식", "배터리"), ("빅",), ("업황", "업계"), ("시험대", "재평가", "기대감"),
    ("쏠린", "주목", "이목"), ("남는", "진짜", "쫄"),
]
# fixed value: three or more names in a row
NAME_LIST = r"[가-힣A-Za-z]{2}[·,]\s*[가-힣A-Za-z]{2,}[·,]\s*[가-힣A-Za-z]{2}"

# fixed value: titles of opinion pieces
OPINION = (
    r"사설|칼럼|기고|기자\s*수첩|데스크|논설|시론|만평|만화경|"
    r"[월화수목금]요\s*광장|광장\]|"
    r"\[사설\]|\[시론\]|\[기고\]|\[초점\]|\[진단\]|\[시선\]|\[돋보기\]|\[뷰\]"
)

# fixed values: the term that a question asks for, and particles at its end
ASKED_TERM = r"([A-Za-z가-힣0-9]+)\s*(?:이|가|은|는|란|이란)?\s*(?:뭐|뜻|정의|무슨|무엇)"
PARTICLES = ("이", "가", "은", "는", "란", "이란", "라는", "라고", "가요", "이가")

# fixed values: what table headers and cells of a report show
YEAR_KIND = r"(?:[1-4]Q)?(20\d{2})\.?\s*([AEFP])(?![A-Za-z가-힣])"
KIND_OF_LETTER = {"A": "actual", "E": "estimate", "F": "forecast", "P": "estimate"}
GUIDANCE = r"(?i)(가이던스|guidance|회사\s*가이드|사측\s*전망)"
UNITS = r"(십억원|백만원|억원|천원|백만달러|백만USD|원|달러|USD|%|배|주|천주|천대)"
MERGED_NUMBERS = r"^((?:\d+\s+)+)((?:,\s*)+)(.*)$"

# fixed values: how an article stands to the story before it
STORY_RELATIONS = ("initial", "follow_up", "reaction", "unknown")

# fixed values: words that show what a question asks for
ASKS_NUMBER = (
    "매출",
    "매출액",
    "영업이익",
    "순이익",
    "당기순이익",
    "eps",
    "주당순이익",
    "발행주식",
    "계약금액",
    "전환가액",
    "수익률",
    "등락률",
    "배당",
    "자산",
    "부채",
    "자본",
    "현금흐름",
    "주식수",
)
ASKS_EXPLAIN = (
    "왜",
    "이유",
    "원인",
    "의미",
    "중요",
    "영향",
    "위험",
    "평가",
    "핵심",
    "배경",
    "설명",
    "이슈",
    "논란",
    "반응",
    "동향",
    "소식",
)
ASKS_TERM = ("뭐야", "뜻", "정의", "무슨 말", "무슨말", "뭔가요", "무엇")
ASKS_PRICE = ("주가", "현재가", "올랐", "내렸", "거래량", "시세")
ASKS_CORRECTION = ("정정", "정정 전", "정정 후", "바뀐", "변경")
ASKS_REPORT = (
    "전망",
    "목표주가",
    "목표가",
    "투자의견",
    "증권사",
    "리포트",
    "레포트",
    "보고서",
    "애널리스트",
    "컨센서스",
    "매수의견",
    "매도의견",
    "상향",
    "하향",
    "목표 주가",
)
ASKS_FILING = ("공시", "자기주식", "증자", "배당", "계약", "처분", "취득")

# fixed values: filing titles by priority
LOW_PRIORITY_PATTERNS = (
    "임원ㆍ주요주주특정증권등소유상황보고서",
    "임원·주요주주특정증권등소유상황보고서",
    "주식등의대량보유상황보고서",
)
IMPORTANT_PATTERNS = (
    "사업보고서",
    "반기보고서",
    "분기보고서",
    "주요사항보고서",
    "잠정)실적",
    "잠정실적",
    "단일판매ㆍ공급계약",
    "단일판매·공급계약",
    "현금ㆍ현물배당",
    "현금·현물배당",
    "유상증자",
    "무상증자",
    "감자",
    "전환사채",
    "신주인수권부사채",
    "교환사채",
    "자기주식취득",
    "자기주식처분",
    "자기주식 취득",
    "자기주식 처분",
    "합병",
    "분할",
    "자산양수",
    "자산 양수",
    "자산양도",
    "자산 양도",
    "영업양수",
    "영업 양수",
    "영업양도",
    "영업 양도",
    "주주총회",
    "기업설명회(IR)",
    "주주명부폐쇄",
    "기준일",
)
CORE_TITLES = ("사업보고서", "반기보고서", "분기보고서", "주요사항보고서")

# fixed values: entities that text keeps as signs
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}
# fixed values: fields of a filing row that carry no business content, and values that count as empty
META_FIELDS = ("status", "message", "corp_code", "corp_cls", "corp_name", "stock_code")
NON_BUSINESS_FIELDS = META_FIELDS + ("rcept_no", "stlm_dt")
EMPTY_VALUES = ("", "-", "―", "－", "N/A", "해당사항없음", "해당없음")
# fixed values: report codes in the order of the year (first quarter, half, third quarter, annual)
REPORT_RANK = {"11013": 1, "11012": 2, "11014": 3, "11011": 4}
# fixed values: openings that a brief leaves out
BRIEF_OPENINGS = ("쉽게 말해,", "쉽게 말하면,", "이 기사는 ")
# fixed values: prices of a language model call in dollars per million tokens
PROMPT_PRICE, COMPLETION_PRICE = 0.15, 0.60

#: Lines of a page that are no part of its body.
BOILERPLATE = [
    r"무단\s*전재.*재배포\s*금지",
    r"저작권자.*금지",
    r"기자\s*\([^)]*@[^)]*\)",
    r"제보는\s*카카오톡",
    r"^(구독하기|기사\s*스크랩|댓글|글자\s*크기|앱에서\s*읽기|로그인)$",
]

#: Elements that hold an article's text.
ARTICLE_SELECTORS = [
    "article",
    "#articleBody",
    "#article-body",
    "#articleBodyContents",
    "#newsEndContents",
    "#dic_area",
    ".article-body",
    ".article_body",
    ".article-view-content-div",
    ".newsct_article",
    ".news_cnt_detail_wrap",
    ".story-news.article",
    ".articletext2",
    ".detail_editor",
]
#: Hosts whose article stands in one known element, hosts of short articles, and addresses of publishers' replies.
PREFERRED_SELECTORS = {"www.edaily.co.kr": ".news_body", "www.ulsanpress.net": "#article-view-content-div"}
SHORT_ARTICLE_HOSTS = ("www.bigtanews.co.kr", "www.edaily.co.kr", "www.ulsanpress.net")
PUBLISHER_REPLIES = {"biz.sbs.co.kr": "https://apis.sbs.co.kr/play-api/1.0/sbs_newsmedia/", "news.cpbc.co.kr": "https://apis.cpbc.co.kr/play-api/1.0/sbs_newsmedia/"}
#: Marks and fields of article text in the state of a page.
ELEMENTS_MARK = "Fusion.globalContent="
ELEMENT_KINDS = ("text", "header", "quote")
STATE_LIST = "contentArrange"
STATE_FIELDS = ("contentArrange", "articleInnerTextContent", "articleContent")

#: Fonts and sizes of a printed glossary, and the label of related terms.
TITLE_FONT, TITLE_LATIN_FONT, TITLE_SIZE = "ExtraBold", "DIN-Bold", 12.0
RELATED_FONT, RELATED_SIZES, RELATED_LABEL = "Dotum", (8.7, 9.6), "연관검색어"
HEAD_FONT, NUMBER_FONT, LEAST_SIZE = "NanumSquare", "Dinlig", 7.5

#: What tools say beside their rows, or instead of them.
NO_NEWS = "해당 조건의 뉴스를 찾지 못했습니다."
NO_FILINGS = "해당 조건의 공시를 찾지 못했습니다."
NO_VALUES = "해당 조건의 구조화 공시 값을 찾지 못했습니다."
NO_REPORTS = "해당 조건의 증권사 리포트를 찾지 못했습니다."
NO_FACTS = "요청한 재무 데이터가 없습니다."
NO_TERM = "용어를 찾지 못했습니다."
FORECASTS = "증권사 목표주가·전망은 예측치이며 확정 실적이 아님."
EXCLUDED = "제외 요청 주제: {}. 이 주제에 해당하는 근거는 답변에서 제외할 것."
INCLUDED = "포함 요청 주제: {}."

#: Kinds of company events by what their filings' titles hold, and labels before a value in their texts.
EVENT_TITLES = (
    ("shareholders_meeting", ("주주총회소집결의", "주주총회소집공고", "정기주주총회결과")),
    ("dividend", ("현금ㆍ현물배당", "현금·현물배당")),
    ("ir", ("기업설명회(IR)",)),
    ("earnings", ("잠정)실적", "잠정실적")),
    ("record_date", ("기준일",)),
    ("book_closure", ("주주명부폐쇄",)),
)
EVENT_DATES = {
    "shareholders_meeting": ("주주총회 예정일", "주주총회일", "개최일시", "일시"),
    "dividend": ("배당기준일", "배당금지급 예정일자", "지급예정일"),
    "ir": ("개최일시", "개최 일시", "일시"),
    "earnings": ("실적공시 예정일", "발표예정일", "예정일"),
    "record_date": ("기준일",),
    "book_closure": ("폐쇄기간 시작", "시작일", "기준일"),
}
EVENT_ENDS = ("종료일", "폐쇄기간 종료", "종료 예정일")
EVENT_TIMES = ("개최시간", "개최 시각", "일시", "시간")
EVENT_PLACES = ("개최장소", "개최 장소", "장소")
EVENT_DATE = r"(\d{4})\s*[.년/-]\s*(\d{1,2})\s*[.월/-]\s*(\d{1,2})\s*일?"
EVENT_TIME = r"(\d{1,2})\s*[:시]\s*(\d{1,2})?\s*분?"
DIVIDEND = r"(?:1주당|주당)\s*(?:현금)?배당금.{0,80}?(-?[\d,]+)\s*원"

#: Kinds of major events: own name, name of the request, name as printed.
MAJOR_EVENTS = (
    ("default_occurrence", "dfOcr", "부도발생"),
    ("bond_transfer_decision", "stkrtbdTrfDecsn", "주권 관련 사채권 양도 결정"),
    ("rehabilitation_filing", "ctrcvsBgrq", "회생절차 개시신청"),
    ("dissolution_cause", "dsRsOcr", "해산사유 발생"),
    ("paid_in_capital_increase", "piicDecsn", "유상증자 결정"),
    ("free_capital_increase", "fricDecsn", "무상증자 결정"),
    ("paid_free_capital_increase", "pifricDecsn", "유무상증자 결정"),
    ("capital_reduction", "crDecsn", "감자 결정"),
    ("creditor_bank_mgmt_start", "bnkMngtPcbg", "채권은행 등의 관리절차 개시"),
    ("litigation_filed", "lwstLg", "소송 등의 제기"),
    ("overseas_listing_decision", "ovLstDecsn", "해외 증권시장 주권등 상장 결정"),
    ("overseas_delisting_decision", "ovDlstDecsn", "해외 증권시장 주권등 상장폐지 결정"),
    ("overseas_listing", "ovLst", "해외 증권시장 주권등 상장"),
    ("overseas_delisting", "ovDlst", "해외 증권시장 주권등 상장폐지"),
    ("convertible_bond_issue", "cvbdIsDecsn", "전환사채권 발행결정"),
    ("bond_with_warrant_issue", "bdwtIsDecsn", "신주인수권부사채권 발행결정"),
    ("exchangeable_bond_issue", "exbdIsDecsn", "교환사채권 발행결정"),
    ("creditor_bank_mgmt_stop", "bnkMngtPcsp", "채권은행 등의 관리절차 중단"),
    ("contingent_capital_bond_issue", "wdCocobdIsDecsn", "상각형 조건부자본증권 발행결정"),
    ("asset_transfer_etc_putback", "astInhtrfEtcPtbkOpt", "자산양수도(기타), 풋백옵션"),
    ("other_corp_stock_transfer", "otcprStkInvscrTrfDecsn", "타법인 주식 및 출자증권 양도결정"),
    ("tangible_asset_transfer", "tgastTrfDecsn", "유형자산 양도 결정"),
    ("tangible_asset_acquisition", "tgastInhDecsn", "유형자산 양수 결정"),
    ("other_corp_stock_acquisition", "otcprStkInvscrInhDecsn", "타법인 주식 및 출자증권 양수결정"),
    ("business_transfer", "bsnTrfDecsn", "영업양도 결정"),
    ("business_acquisition", "bsnInhDecsn", "영업양수 결정"),
    ("treasury_trust_terminate", "tsstkAqTrctrCcDecsn", "자기주식취득 신탁계약 해지 결정"),
    ("treasury_trust_conclude", "tsstkAqTrctrCnsDecsn", "자기주식취득 신탁계약 체결 결정"),
    ("treasury_stock_disposal", "tsstkDpDecsn", "자기주식 처분 결정"),
    ("treasury_stock_acquisition", "tsstkAqDecsn", "자기주식 취득 결정"),
    ("stock_exchange_transfer", "stkExtrDecsn", "주식교환·이전 결정"),
    ("division_merger", "cmpDvmgDecsn", "회사분할합병 결정"),
    ("company_division", "cmpDvDecsn", "회사분할 결정"),
    ("company_merger", "cmpMgDecsn", "회사합병 결정"),
    ("bond_acquisition_decision", "stkrtbdInhDecsn", "주권 관련 사채권 양수 결정"),
    ("business_suspension", "bsnSp", "영업정지"),
)
