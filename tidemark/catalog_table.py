"""The catalogue as a table."""

#: Fixed values, one indicator a line:
#: id | aliases | name=default:least:most of each parameter | outputs | pane | measure | painter | scale | levels
TABLE = """
[Trend]
AdaptiveLaguerreFilter | alf | gamma=0.8:0.000001:0.999999 | line | Overlay | Price |  |  |
Alligator | alligator | jawLength=13:1:200 jawShift=8:0:100 teethLength=8:1:200 teethShift=5:0:100 lipsLength=5:1:200 lipsShift=3:0:100 | jaw teeth lips | Overlay | Price | alligator |  |
ArnaudLegouxMovingAverage | alma | length=9:1:500 offset=0.85:0.000001:0.999999 sigma=6:1:500 | line | Overlay | Price |  |  |
Aroon | aroon | length=14:1:500 | up down | Separate | Percent |  | 0:100 | 30 70
AroonOscillator | aroonoscillator | length=14:1:500 | line | Separate | Percent |  | -100:100 | -50 0 50
AverageDirectionalIndex | adx | length=14:1:100 | dx adx | Separate | Percent | adx |  |
DirectionalIndex | dx | length=5:1:500 | plusDI minusDI dx | Separate | Percent |  | 0:100 | 25
DoubleExponentialMovingAverage | dema | length=32:1:500 | line | Overlay | Price |  |  |
EndpointMovingAverage | endpointma | length=10:1:500 | line | Overlay | Price |  |  |
ExponentialMovingAverage | ema | length=32:1:500 | line | Overlay | Price |  |  |
FractalAdaptiveMovingAverage | frama | length=20:4:500 | line | Overlay | Price |  |  |
GuppyMultipleMovingAverage | gmma |  | short3 short5 short8 short10 short12 short15 long30 long35 long40 long45 long50 long60 | Overlay | Price |  |  |
HullMovingAverage | hma | length=10:1:500 sqrtPeriod=0:0:500 | line | Overlay | Price |  |  |
Ichimoku | ichimoku | tenkanLength=9:2:200 kijunLength=26:2:400 senkouBLength=52:1:400 chinkouLength=26:1:400 | tenkan kijun senkouA senkouB chikou | Overlay | Price | ichimoku |  |
JurikMovingAverage | jma | length=20:1:500 phase=0:-100:100 | line | Overlay | Price |  |  |
KalmanFilter | kalman kalmanfilter | length=10:1:500 processNoise=0.00001:1e-12:1e12 measurementNoise=0.001:1e-12:1e12 | line | Overlay | Price |  |  |
KaufmanAdaptiveMovingAverage | kama | length=1:1:500 fastSCPeriod=2:1:500 slowSCPeriod=30:1:500 | line | Overlay | Price |  |  |
LinearReg | linreg | length=11:1:500 | line | Overlay | Price |  |  |
LinearRegressionForecast | linregforecast | length=14:1:500 | line | Overlay | Price |  |  |
LinearRegSlope | linregslope | length=11:1:500 | line | Separate | MinusOnePlusOne |  |  |
McGinleyDynamic | mcginley mcginleydynamic | length=14:1:500 | line | Overlay | Price |  |  |
Median | median | length=5:1:500 | line | Overlay | Price |  |  |
MovingAverageCrossover | macross movingaveragecrossover | shortPeriod=25:1:500 longPeriod=50:1:500 | signal | Separate | MinusOnePlusOne |  | -1:1 | 0
MovingAverageRibbon | maribbon movingaverageribbon | shortPeriod=10:1:500 longPeriod=100:1:1000 ribbonCount=10:2:500 | ribbon* | Overlay | Price |  |  |
NickRypockTrailingReverse | nrtr | length=50:1:500 multiple=100:0:1000 | line | Overlay | Price |  |  |
OptimalTracking | optimaltracking | length=2:2:500 | line | Overlay | Price |  |  |
ParabolicSar | psar parabolicsar | acceleration=0.02:0.0001:10 accelerationStep=0.02:0.0001:10 accelerationMax=0.2:0.0001:10 | value | Overlay | Price | dots |  |
RainbowCharts | rainbow rainbowcharts | lines=10:2:500 | sma* | Overlay | Price |  |  |
SimpleMovingAverage | sma | length=32:1:500 | line | Overlay | Price |  |  |
SmoothedMovingAverage | smma | length=32:1:500 | line | Overlay | Price |  |  |
SuperTrend | supertrend | length=10:1:500 multiplier=3:0.000001:500 | value | Overlay | Price |  |  |
T3MovingAverage | t3 | length=5:1:500 volumeFactor=0.7:0.000001:0.999999 | line | Overlay | Price |  |  |
TripleExponentialMovingAverage | tema | length=32:1:500 | line | Overlay | Price |  |  |
VariableMovingAverage | vma variablemovingaverage | length=20:1:500 volatilityIndex=0.2:0.0001:10 | line | Overlay | Price |  |  |
Vidya | vidya | length=15:1:500 | line | Overlay | Price |  |  |
WeightedMovingAverage | wma | length=32:1:500 | line | Overlay | Price |  |  |
WilderMovingAverage | wilderma wildermovingaverage | length=32:1:500 | line | Overlay | Price |  |  |
ZeroLagExponentialMovingAverage | zlema zerolagexponentialmovingaverage | length=14:1:500 | line | Overlay | Price |  |  |
[Momentum]
Acceleration | ac acceleration | shortMaLength=5:1:500 longMaLength=34:1:500 smaLength=5:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
AwesomeOscillator | ao awesomeoscillator | shortMaLength=5:1:500 longMaLength=34:1:500 | value | Separate | MinusOnePlusOne | directional-histogram |  | 0
ChandeMomentumOscillator | cmo | length=15:1:500 | line | Separate | Percent |  | -100:100 | -50 0 50
CompositeMomentum | compositemomentum | shortRocLength=14:1:500 longRocLength=28:1:500 rsiLength=14:1:500 emaFastLength=12:1:500 emaSlowLength=26:1:500 smaLength=9:1:500 | composite sma | Separate | Percent |  |  |
ConnorsRSI | connorsrsi | rsiPeriod=3:1:500 streakRSIPeriod=2:1:500 rocRSIPeriod=100:1:1000 | rsi updown rocrsi crsi | Separate | Percent |  | 0:100 | 10 90
ConstanceBrownCompositeIndex | cbci | rsiLength=14:1:500 rocLength=9:1:500 shortRsiLength=3:1:500 momentumLength=3:1:500 fastSmaLength=13:1:500 slowSmaLength=33:1:500 | composite fastSma slowSma | Separate | Percent |  |  |
DeMarker | demarker | length=14:1:500 | line | Separate | MinusOnePlusOne |  | 0:1 | 0.3 0.7
DisparityIndex | disparityindex | length=14:1:500 | line | Separate | Percent |  |  | 0
DynamicZonesRSI | dzrsi | length=14:1:500 oversoldLevel=20:0:100 overboughtLevel=80:0:100 | line | Separate | Percent |  | 0:100 |
ElderImpulseSystem | elderimpulse | emaLength=13:1:500 shortMaLength=12:1:500 longMaLength=26:1:500 | impulse | Separate | MinusOnePlusOne |  | -1:1 | 0
ElliotWaveOscillator | ewo | shortPeriod=5:1:500 longPeriod=34:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
ForecastOscillator | forecastoscillator | length=14:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
GatorOscillator | gator gatoroscillator | jawLength=13:1:200 jawShift=8:0:100 teethLength=8:1:200 teethShift=5:0:100 lipsLength=5:1:200 lipsShift=3:0:100 | upper lower | Separate | MinusOnePlusOne | gator |  |
IntradayMomentumIndex | imi | length=14:1:500 | line | Separate | Percent |  | 0:100 | 30 70
KasePeakOscillator | kpo | shortPeriod=9:1:500 longPeriod=18:1:500 | shortTerm longTerm | Separate | Percent |  |  |
KnowSureThing | kst | roc1Length=10:1:500 roc2Length=15:1:500 roc3Length=20:1:500 roc4Length=30:1:500 sma1Length=10:1:500 sma2Length=10:1:500 sma3Length=10:1:500 sma4Length=15:1:500 signalLength=9:1:500 | kst signal | Separate | MinusOnePlusOne |  |  |
LaguerreRSI | laguerrersi | gamma=0.7:0.000001:0.999999 | line | Separate | Percent |  | 0:100 | 20 80
Momentum | momentum | length=5:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
MomentumOfMovingAverage | momma momentumofmovingaverage | length=14:1:500 momentumPeriod=10:1:500 | line | Separate | Percent |  |  | 0
MomentumPinball | momentumpinball | length=14:1:500 | line | Separate | Percent |  | -100:100 | 0
MovingAverageConvergenceDivergence | macd | shortMaLength=12:1:500 longMaLength=26:1:500 | macd | Separate | MinusOnePlusOne | line |  |
MovingAverageConvergenceDivergenceHistogram | macdhistogram | shortMaLength=12:1:200 longMaLength=26:1:400 signalMaLength=9:1:100 | macd signal histogram | Separate | MinusOnePlusOne | macd-histogram |  |
MovingAverageConvergenceDivergenceSignal | macdsignal | longMaLength=26:1:500 shortMaLength=12:1:500 signalMaLength=9:1:500 | macd signal | Separate | MinusOnePlusOne | dual-line |  |
OscillatorOfMovingAverage | osma oscillatorofmovingaverage | shortPeriod=10:1:500 longPeriod=30:1:500 | line | Separate | Percent |  |  | 0
PercentagePriceOscillator | ppo | shortPeriod=12:1:200 longPeriod=26:1:400 | ppo | Separate | Percent | line |  | 0
PercentagePriceOscillatorHistogram | ppohistogram | shortPeriod=12:1:200 longPeriod=26:1:400 signalMaLength=9:1:100 | ppo signal histogram | Separate | Percent | ppo-histogram |  | 0
PercentagePriceOscillatorSignal | pposignal | shortPeriod=12:1:200 longPeriod=26:1:400 signalMaLength=9:1:100 | ppo signal | Separate | Percent | dual-line |  | 0
PrettyGoodOscillator | pgo prettygoodoscillator | length=14:1:500 | line | Separate | Percent |  |  | 0
PsychologicalLine | psy psychologicalline | length=20:1:500 | line | Separate | MinusOnePlusOne |  | 0:1 | 0.25 0.75
QStick | qstick | length=15:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
RankCorrelationIndex | rci rankcorrelationindex | length=14:1:500 | line | Separate | MinusOnePlusOne |  | -1:1 | 0
RateOfChange | roc rateofchange | length=5:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
RelativeMomentumIndex | rmi relativemomentumindex | length=14:1:500 momentumPeriod=3:1:500 | line | Separate | Percent |  | 0:100 | 30 70
RelativeStrengthIndex | rsi | length=15:1:500 | oscillator | Separate | Percent |  | 0:100 | 30 70
RelativeVigorIndex | rvi relativevigorindex | averageLength=4:4:200 signalLength=4:4:100 | rvi signal | Separate | MinusOnePlusOne | dual-line | -1:1 | 0
StochasticK | stochastick | length=14:1:500 | line | Separate | Percent |  | 0:100 | 20 80
StochasticOscillator | stochastic | kLength=14:1:200 dLength=3:1:100 | k d | Separate | Percent | stochastic | 0:100 | 20 80
Trix | trix | length=32:1:500 rocLength=1:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
TrueStrengthIndex | tsi truestrengthindex | firstLength=25:1:500 secondLength=13:1:500 signalLength=7:1:500 | tsi signal | Separate | Percent |  | -100:100 | -25 0 25
UltimateOscillator | uo ultimateoscillator |  | line | Separate | Percent |  | 0:100 | 30 70
WaveTrendOscillator | wto wavetrend wavetrendoscillator | esaPeriod=10:1:500 dPeriod=14:1:500 averagePeriod=3:1:500 | wt1 wt2 | Separate | Percent |  |  |
WilliamsR | williamsr | length=5:1:500 | line | Separate | Percent |  | -100:0 | -80 -20
WoodiesCCI | wcci woodiescci | length=14:1:500 smaLength=6:1:500 | cci signal | Separate | Percent |  |  | -100 0 100
[Volatility]
AdaptivePriceZone | apz | period=5:1:500 bandPercentage=2:0:500 | ma upper lower | Overlay | Price | band |  |
AverageTrueRange | atr | length=32:1:500 | line | Separate | MinusOnePlusOne |  |  |
BollingerBands | bb | length=32:1:500 width=2:0.1:5 upBandWidth=2:-5:5 lowBandWidth=-2:-5:5 | upper middle lower | Overlay | Price | band |  |
BollingerPercentB | bbpercentb | length=20:1:500 stdDevMultiplier=2:0.1:500 | line | Separate | Percent |  |  | 0 100
ChaikinVolatility | chaikinvolatility | emaLength=32:1:500 rocLength=5:1:500 | line | Separate | Percent |  |  | 0
Envelope | envelope | length=32:1:500 shift=0.01:0:100 | upper middle lower | Overlay | Price | band |  |
GopalakrishnanRangeIndex | gri | length=14:1:500 | line | Separate | MinusOnePlusOne |  |  |
HistoricalVolatilityRatio | hvr | shortPeriod=5:1:500 longPeriod=20:1:500 | line | Separate | Percent |  |  | 1
KeltnerChannels | keltner keltnerchannels | length=20:1:500 multiplier=2:0.000001:500 | upper middle lower | Overlay | Price |  |  |
MassIndex | massindex | length=25:1:500 emaLength=9:2:500 | line | Separate | MinusOnePlusOne |  |  | 26.5 27
MeanDeviation | meandeviation | length=5:1:500 | line | Separate | MinusOnePlusOne |  |  |
StandardDeviation | stddev standarddeviation | length=10:1:500 | line | Separate | MinusOnePlusOne |  |  |
TrueRange | tr truerange |  | line | Separate | MinusOnePlusOne |  |  |
[Volume]
AccumulationDistributionLine | adl |  | line | Overlay | Price |  |  |
ApprovalFlowIndex | afi approvalflowindex | length=14:1:500 | line | Separate | Percent |  | 0:100 | 50
BalanceVolume | obv balancevolume |  | line | Separate | Volume |  |  |
ChaikinMoneyFlow | cmf | length=20:1:500 | line | Separate | MinusOnePlusOne |  | -1:1 | 0
DemandIndex | demandindex | length=14:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
EaseOfMovement | eom | length=14:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
ElderForceIndex | elderforceindex forceindexelder | length=13:1:500 | line | Separate | Volume | line |  | 0
FiniteVolumeElement | fve | length=22:1:500 | line | Separate | Percent |  |  | 0
ForceIndex | forceindex elderforceindex ElderForceIndex | length=13:1:500 | line | Separate | Volume |  |  | 0
IntradayIntensityIndex | iii | length=14:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
KlingerVolumeOscillator | kvo | shortPeriod=34:1:500 longPeriod=55:1:500 | shortEma longEma oscillator | Overlay | Price |  |  |
MarketFacilitationIndex | marketfacilitationindex |  | line | Separate | MinusOnePlusOne |  |  |
MoneyFlowIndex | mfi moneyflowindex | length=14:1:500 | line | Separate | Percent |  | 0:100 | 20 80
NegativeVolumeIndex | nvi negativevolumeindex |  | line | Separate | Percent |  |  |
OnBalanceVolume | onbalancevolume |  | line | Separate | Volume |  |  |
OnBalanceVolumeMean | obvmean onbalancevolumemean | length=32:1:500 | line | Separate | Volume |  |  |
PercentageVolumeOscillator | pvo | shortPeriod=12:1:500 longPeriod=26:1:500 | shortEma longEma pvo | Separate | Volume |  |  |
PositiveVolumeIndex | pvi positivevolumeindex |  | line | Separate | Percent |  |  |
PriceVolumeTrend | pvt pricevolumetrend |  | line | Separate | Volume |  |  |
TwiggsMoneyFlow | tmf twiggsmoneyflow | length=21:1:500 | line | Separate | MinusOnePlusOne |  | -1:1 | 0
VolumeIndicator | volume |  | value | Separate | Volume | volume |  |
VolumeWeightedAveragePrice | vwap volumeweightedaverageprice |  | line | Overlay | Price |  |  |
VolumeWeightedMovingAverage | vwma volumeweightedmovingaverage | length=32:1:500 | line | Overlay | Price |  |  |
WilliamsAccumulationDistribution | wad williamsad williamsaccumulationdistribution |  | line | Separate | Volume |  |  |
WilliamsVariableAccumulationDistribution | wvad williamsvariableaccumulationdistribution |  | line | Separate | Volume |  |  |
[Price]
DetrendedSyntheticPrice | dsp | length=14:1:500 | line | Overlay | Price |  |  |
MedianPrice | medianprice |  | line | Overlay | Price |  |  |
PassThroughIndicator | passthrough |  | line | Overlay | Price |  |  |
Shift | shift | length=1:1:500 | line | Overlay | Price |  |  |
TimeWeightedAveragePrice | twap timeweightedaverageprice |  | line | Overlay | Price |  |  |
TypicalPrice | tp typicalprice |  | line | Overlay | Price |  |  |
WeightedClosePrice | wcp weightedcloseprice |  | line | Overlay | Price |  |  |
[SupportResistance]
ChandeKrollStop | chandekrollstop | period=10:1:500 multiplier=1.5:0.001:30 stopPeriod=9:1:500 | longStop shortStop | Overlay | Price | dual-line |  |
DonchianChannels | donchian donchianchannels | length=20:1:500 | upper middle lower | Overlay | Price | band |  |
FibonacciRetracement | fibo | length=20:1:500 | l236 l382 l500 l618 l786 | Overlay | Price |  |  |
Fractals | fractals | length=5:3:99 | up down | Overlay | Price | fractals |  |
Highest | highest | length=5:1:500 | line | Overlay | Price |  |  |
Lowest | lowest | length=5:1:500 | line | Overlay | Price |  |  |
Peak | peak | deviation=0.001:0.001:0.999 | value | Overlay | Price |  |  |
PivotPoints | pivotpoints |  | pp r1 r2 s1 s2 | Overlay | Price |  |  |
PriceChannels | pc pricechannels | length=20:1:500 | upper lower | Overlay | Price | band |  |
Trough | trough | deviation=0.001:0.001:0.999 | value | Overlay | Price |  |  |
ZigZag | zigzag | deviation=0.001:0.001:0.5 | value | Overlay | Price |  |  |
[MarketStrength]
BalanceOfMarketPower | bomp | length=14:1:500 | line | Separate | MinusOnePlusOne |  | -1:1 | 0
BalanceOfPower | balanceofpower |  | line | Separate | MinusOnePlusOne |  | -1:1 | 0
BearPower | bearpower | length=32:1:500 | line | Separate | Percent |  |  | 0
BullPower | bullpower | length=32:1:500 | line | Separate | Percent |  |  | 0
ChoppinessIndex | chop | length=14:1:500 | line | Separate | Percent |  | 0:100 | 38.2 61.8
ElderRay | elderray | length=13:1:500 | bull bear | Separate | Percent |  |  | 0
HighLowIndex | highlowindex | length=14:1:500 | line | Separate | Percent |  | 0:100 | 50
KaufmanEfficiencyRatio | ker | length=10:1:500 | line | Separate | MinusOnePlusOne |  | 0:1 |
MarketMeannessIndex | mmi marketmeannessindex | length=200:2:2000 | line | Separate | Percent |  |  | 50
McClellanOscillator | mcclellanosc mcclellanoscillator | ema19Length=19:1:500 ema39Length=39:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
RangeActionVerificationIndex | ravi rangeactionverificationindex | shortSmaLength=7:1:500 longSmaLength=65:1:650 | line | Separate | MinusOnePlusOne |  |  |
VerticalHorizontalFilter | vhf verticalhorizontalfilter | length=15:1:500 | line | Separate | MinusOnePlusOne |  |  |
VortexIndicator | vi vortex vortexindicator | length=14:1:500 | viPlus viMinus | Separate | MinusOnePlusOne |  |  | 1
[Cycle]
CenterOfGravityOscillator | cog cgo | length=10:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
DetrendedPriceOscillator | dpo | length=3:1:500 | line | Separate | MinusOnePlusOne |  |  | 0
EhlersFisherTransform | ehlerfisher | length=10:1:500 | main trigger | Separate | MinusOnePlusOne |  |  | 0
HarmonicOscillator | harmonic harmonicoscillator | length=14:1:500 | line | Separate | Percent |  |  | 0
LunarPhase | lunarphase |  | line | Separate | MinusOnePlusOne |  | 0:7 |
SchaffTrendCycle | stc schafftrendcycle | length=32:1:500 shortMaLength=23:1:500 longMaLength=50:1:500 stochasticKLength=5:1:500 signalMaLength=3:1:500 | line | Separate | Percent |  | 0:100 | 25 75
SineWave | sinewave | length=14:1:500 | sine leadsine | Separate | MinusOnePlusOne |  | -1:1 | 0
[Statistical]
CommodityChannelIndex | cci | length=15:1:500 | line | Separate | Percent |  |  | -100 0 100
FractalDimension | fractaldimension | length=30:1:500 | line | Separate | MinusOnePlusOne |  | 1:2 | 1.5
HurstExponent | hurst hurstexponent | length=100:1:1000 | line | Separate | MinusOnePlusOne |  | 0:1 | 0.5
LinearRegRSquared | rsquared linregrsquared | length=10:1:500 | line | Separate | MinusOnePlusOne |  | 0:1 |
StandardError | stderr standarderror | length=10:1:500 | line | Separate | MinusOnePlusOne |  |  |
Sum | sum | length=15:1:500 | line | Separate | Volume |  |  |
"""
