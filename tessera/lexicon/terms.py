"""Words of business texts: acronyms with what they stand for, and words of about the same meaning; each one a line of plain text."""

_ACRONYMS = """
ABS asset backed securities
AFS available for sale
AI artificial intelligence
AOCI accumulated other comprehensive income
API application programming interface
APIC additional paid in capital
AR accounts receivable
ARPU average revenue per user
ARR annual recurring revenue
ASC accounting standards codification
ASP average selling price
ASR accelerated share repurchase
ASU accounting standards update
ATM at the market offering
AUM assets under management
AWS amazon web services
B2B business to business
B2C business to consumer
BPS basis points
BV book value
CAC customer acquisition cost
CAGR compound annual growth rate
CAM critical audit matter
CAPEX capital expenditures
CAPM capital asset pricing model
CECL current expected credit loss
CEO chief executive officer
CFO chief financial officer
CFPB consumer financial protection bureau
CIO chief information officer
CISO chief information security officer
CLO collateralized loan obligation
CMO chief marketing officer
COGS cost of goods sold
COO chief operating officer
CPI consumer price index
CRE commercial real estate
CRM customer relationship management
CRO chief risk officer
CSR corporate social responsibility
CTO chief technology officer
D&A depreciation and amortization
D&O directors and officers
DAU daily active users
DCF discounted cash flow
DEI diversity equity and inclusion
DOJ department of justice
DPO days payable outstanding
DPS dividends per share
DRIP dividend reinvestment plan
DSO days sales outstanding
DTA deferred tax asset
DTL deferred tax liability
EBIT earnings before interest and taxes
EBITDA earnings before interest taxes depreciation and amortization
EBT earnings before taxes
ECL expected credit loss
EMEA europe middle east and africa
EPA environmental protection agency
EPS earnings per share
ERM enterprise risk management
ERP enterprise resource planning
ESG environmental social and governance
ESOP employee stock ownership plan
ESPP employee stock purchase plan
ETF exchange traded fund
ETR effective tax rate
EV enterprise value
FASB financial accounting standards board
FCF free cash flow
FDA food and drug administration
FDIC federal deposit insurance corporation
FFO funds from operations
FIFO first in first out
FINRA financial industry regulatory authority
FTC federal trade commission
FTE full time equivalent
FVTPL fair value through profit or loss
FX foreign exchange
FY fiscal year
G&A general and administrative
GAAP generally accepted accounting principles
GDP gross domestic product
GDPR general data protection regulation
GHG greenhouse gas
GM gross margin
GMV gross merchandise value
GPU graphics processing unit
HTM held to maturity
IAAS infrastructure as a service
ICFR internal control over financial reporting
IFRS international financial reporting standards
IOT internet of things
IP intellectual property
IPO initial public offering
IRR internal rate of return
IRS internal revenue service
JV joint venture
KPI key performance indicator
LBO leveraged buyout
LIBOR london interbank offered rate
LIFO last in first out
LLM large language model
LOI letter of intent
LTD long term debt
LTIP long term incentive plan
LTM last twelve months
LTV lifetime value
M&A mergers and acquisitions
MAU monthly active users
MBS mortgage backed securities
MD&A management discussion and analysis
ML machine learning
MOU memorandum of understanding
MRR monthly recurring revenue
MSA master services agreement
NAV net asset value
NDA non disclosure agreement
NEO named executive officer
NI net income
NII net interest income
NIM net interest margin
NOL net operating loss
NOPAT net operating profit after tax
NPL non performing loan
NPS net promoter score
NPV net present value
NRR net revenue retention
NYSE new york stock exchange
OCF operating cash flow
OCI other comprehensive income
OEM original equipment manufacturer
OPEX operating expenses
OTC over the counter
P&L profit and loss
PAAS platform as a service
PCAOB public company accounting oversight board
PE price to earnings
PEG price earnings to growth
PP&E property plant and equipment
PPI producer price index
PSU performance stock unit
QOQ quarter over quarter
R&D research and development
RCF revolving credit facility
REIT real estate investment trust
ROA return on assets
ROC return on capital
ROE return on equity
ROI return on investment
ROIC return on invested capital
ROU right of use asset
RPO remaining performance obligations
RSU restricted stock unit
RWA risk weighted assets
S&M sales and marketing
SAAS software as a service
SAR stock appreciation right
SBC stock based compensation
SEC securities and exchange commission
SG&A selling general and administrative
SKU stock keeping unit
SLA service level agreement
SOFR secured overnight financing rate
SOX sarbanes oxley
SPAC special purpose acquisition company
SPE special purpose entity
T&E travel and entertainment
TAM total addressable market
TCO total cost of ownership
TSR total shareholder return
TTM trailing twelve months
USD united states dollar
VAT value added tax
VIE variable interest entity
VWAP volume weighted average price
WACC weighted average cost of capital
WC working capital
YOY year over year
YTD year to date
"""

_SYNONYMS = """
acquisition: merger, takeover, purchase
advertising: marketing, promotion
ai: machine learning, artificial intelligence
asset: holding, property
audit: review, examination
board: directors, trustees
bonus: incentive, award
buyback: share repurchase, repurchase program
capital: funds, equity
cash: liquidity, cash equivalents
cash flow: liquidity, cash generation
ceo: chief executive, president
charge: cost, write-down
climate: environmental, emissions
competition: rivals, competitors, market pressure
compensation: pay, remuneration, salary
contract: agreement, arrangement
cost: expense, expenditure
cost of sales: cost of revenue, cost of goods sold
customer: client, buyer
cybersecurity: information security, data breach
debt: borrowings, liabilities, indebtedness
decline: decrease, drop, reduction
demand: orders, sales volume
dividend: distribution, payout
earnings: profit, net income
employee: workforce, staff, headcount
expansion: growth, scaling
forecast: outlook, projection, guidance
free cash flow: cash generation, operating cash less capital expenditures
goodwill: intangible assets, acquired value
growth: increase, expansion, rise
guidance: outlook, forecast, expectations
impairment: write-down, write-off
increase: growth, rise, gain
inflation: price increases, rising costs
innovation: research, new products
insurance: coverage, underwriting
interest rate: borrowing cost, yield
inventory: stock, goods on hand
investment: capital spending, stake
lawsuit: litigation, legal proceedings, claim
layoff: workforce reduction, restructuring
lease: rental, tenancy
litigation: lawsuit, legal proceedings
loan: credit, advance
loss: deficit, shortfall
management: leadership, executives
margin: profitability, spread
market share: position, penetration
partner: alliance, collaborator
patent: intellectual property, invention
price: cost, rate
product: offering, goods
profit: earnings, income, gain
regulation: rules, compliance, legislation
restructuring: reorganization, realignment
revenue: sales, turnover, net sales
risk: exposure, uncertainty, threat
segment: division, business unit
share price: stock price, market value
shareholder: stockholder, investor
strategy: plan, approach, initiative
subsidiary: affiliate, unit
supplier: vendor, provider
supply chain: logistics, procurement, sourcing
tariff: duty, trade restriction
tax: levy, income taxes
technology: software, systems
working capital: current assets less liabilities, operating liquidity
"""

#: Acronym -> phrase.
ACRONYMS: dict[str, str] = dict(line.split(" ", 1) for line in _ACRONYMS.strip().split("\n"))

#: Word or phrase -> words that mean about the same.
SYNONYMS: dict[str, list[str]] = {head: meant.split(", ") for head, meant in (line.split(": ", 1) for line in _SYNONYMS.strip().split("\n"))}
