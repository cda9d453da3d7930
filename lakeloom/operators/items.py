"""The fundamental items: their kinds, the tags that carry them in order of priority, and their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fundamentals import Item


def _item(name: str, kind: str, tags: str, nonnegative: bool = False, second_quarter: bool = False) -> Item:
    return Item(name, kind, tuple(tags.split()), nonnegative, second_quarter)


#: Items and tags (fixed values).
ITEMS = [
    # income statement
    _item("revenue", "flow", """
        us-gaap:Revenues us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax us-gaap:RevenueFromContractWithCustomerIncludingAssessedTax
        us-gaap:SalesRevenueNet us-gaap:SalesRevenueGoodsNet us-gaap:SalesRevenueServicesNet ifrs-full:Revenue
        ifrs-full:RevenueFromContractsWithCustomers us-gaap:RevenuesNetOfInterestExpense us-gaap:OperatingLeaseLeaseIncome us-gaap:LeaseIncome
        us-gaap:PremiumsEarnedNet us-gaap:InterestAndDividendIncomeOperating""", nonnegative=True),
    _item("gross_profit", "flow", "us-gaap:GrossProfit ifrs-full:GrossProfit"),
    _item("operating_income", "flow", "us-gaap:OperatingIncomeLoss ifrs-full:ProfitLossFromOperatingActivities"),
    _item("net_income", "flow", """
        us-gaap:NetIncomeLoss us-gaap:NetIncomeLossAvailableToCommonStockholdersBasic us-gaap:ProfitLoss
        ifrs-full:ProfitLossAttributableToOwnersOfParent ifrs-full:ProfitLoss"""),
    _item("cost_of_revenue", "flow", "us-gaap:CostOfRevenue us-gaap:CostOfGoodsAndServicesSold ifrs-full:CostOfSales", nonnegative=True),
    _item("sga", "flow", "us-gaap:SellingGeneralAndAdministrativeExpense ifrs-full:SellingGeneralAndAdministrativeExpense", nonnegative=True),
    _item("rnd", "flow", """
        us-gaap:ResearchAndDevelopmentExpense us-gaap:ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost
        ifrs-full:ResearchAndDevelopmentExpense""", nonnegative=True),
    _item("depreciation_amortization", "flow", """
        us-gaap:DepreciationDepletionAndAmortization us-gaap:DepreciationAndAmortization us-gaap:DepreciationAmortizationAndAccretionNet
        ifrs-full:DepreciationAndAmortisationExpense ifrs-full:AdjustmentsForDepreciationAndAmortisationExpense""", nonnegative=True),
    _item("interest_expense", "flow", """
        us-gaap:InterestExpense us-gaap:InterestExpenseNonoperating us-gaap:InterestExpenseDebt ifrs-full:FinanceCosts
        ifrs-full:InterestExpense""", nonnegative=True),
    _item("pretax_income", "flow", """
        us-gaap:IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest
        us-gaap:IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments
        ifrs-full:ProfitLossBeforeTax"""),
    _item("income_tax", "flow", "us-gaap:IncomeTaxExpenseBenefit ifrs-full:IncomeTaxExpenseContinuingOperations"),
    _item("eps_basic", "per_share", "us-gaap:EarningsPerShareBasic ifrs-full:BasicEarningsLossPerShare"),
    _item("eps_diluted", "per_share", "us-gaap:EarningsPerShareDiluted ifrs-full:DilutedEarningsLossPerShare"),
    # cash flow
    _item("operating_cash_flow", "flow", """
        us-gaap:NetCashProvidedByUsedInOperatingActivities us-gaap:NetCashProvidedByUsedInOperatingActivitiesContinuingOperations
        ifrs-full:CashFlowsFromUsedInOperatingActivities"""),
    _item("capex", "flow", """
        us-gaap:PaymentsToAcquirePropertyPlantAndEquipment us-gaap:PaymentsToAcquireProductiveAssets
        us-gaap:PaymentsToAcquireOilAndGasPropertyAndEquipment us-gaap:PaymentsToAcquireOilAndGasProperty
        us-gaap:PaymentsForCapitalImprovements us-gaap:PaymentsToDevelopRealEstateAssets
        ifrs-full:PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities""", nonnegative=True),
    _item("dividends_paid", "flow", """
        us-gaap:PaymentsOfDividendsCommonStock us-gaap:PaymentsOfDividends us-gaap:PaymentsOfOrdinaryDividends
        ifrs-full:DividendsPaidClassifiedAsFinancingActivities""", nonnegative=True),
    _item("buybacks", "flow", """
        us-gaap:PaymentsForRepurchaseOfCommonStock ifrs-full:PaymentsToAcquireOrRedeemEntitysShares
        ifrs-full:PurchaseOfTreasuryShares""", nonnegative=True),
    _item("stock_comp", "flow", "us-gaap:ShareBasedCompensation us-gaap:AllocatedShareBasedCompensationExpense ifrs-full:AdjustmentsForSharebasedPayments"),
    # balance sheet
    _item("assets", "instant", "us-gaap:Assets ifrs-full:Assets"),
    _item("liabilities", "instant", "us-gaap:Liabilities ifrs-full:Liabilities"),
    _item("equity", "instant", """
        us-gaap:StockholdersEquity us-gaap:StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest
        ifrs-full:EquityAttributableToOwnersOfParent ifrs-full:Equity"""),
    _item("cash", "instant", """
        us-gaap:CashAndCashEquivalentsAtCarryingValue us-gaap:CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents
        ifrs-full:CashAndCashEquivalents"""),
    _item("long_term_debt", "instant", "us-gaap:LongTermDebt us-gaap:LongTermDebtNoncurrent ifrs-full:NoncurrentFinancialLiabilities"),
    _item("current_assets", "instant", "us-gaap:AssetsCurrent ifrs-full:CurrentAssets"),
    _item("current_liabilities", "instant", "us-gaap:LiabilitiesCurrent ifrs-full:CurrentLiabilities"),
    _item("inventory", "instant", "us-gaap:InventoryNet ifrs-full:Inventories"),
    _item("receivables", "instant", """
        us-gaap:AccountsReceivableNetCurrent us-gaap:ReceivablesNetCurrent ifrs-full:TradeAndOtherCurrentReceivables
        ifrs-full:CurrentTradeReceivables"""),
    _item("goodwill", "instant", "us-gaap:Goodwill ifrs-full:Goodwill"),
    _item("debt_current", "instant", """
        us-gaap:LongTermDebtCurrent us-gaap:LongTermDebtAndCapitalLeaseObligationsCurrent
        ifrs-full:CurrentPortionOfLongtermBorrowings"""),
    _item("short_term_borrowings", "instant", "us-gaap:ShortTermBorrowings us-gaap:CommercialPaper ifrs-full:ShorttermBorrowings"),
    # cover page
    _item("public_float", "instant", "dei:EntityPublicFloat", nonnegative=True, second_quarter=True),
]

#: Balance-sheet totals that date a fiscal year's end, and share counts in order of priority (fixed values).
FISCAL_YEAR_END_TAGS = ["us-gaap:Assets", "us-gaap:StockholdersEquity", "ifrs-full:Assets"]
SHARE_TAGS = ["dei:EntityCommonStockSharesOutstanding", "us-gaap:CommonStockSharesOutstanding", "us-gaap:WeightedAverageNumberOfSharesOutstandingBasic"]


def qualified(facts: DataFrame) -> DataFrame:
    """Facts whose ``tag`` carries its taxonomy, as the items name it."""
    return facts.withColumn("tag", F.concat_ws(":", "taxonomy", "tag"))
