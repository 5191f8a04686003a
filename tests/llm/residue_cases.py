"""Texts labelled by hand, in wording that no rule of the operator was written for: 1 residue, 0 sound."""

CASES = [
    (1, "500 Internal Server Error\nThe server was unable to complete your request."),
    (1, "404\nWe could not find the document you asked for."),
    (1, "Document portal\nThe file bundle_12.pdf was not found on this server.\nPrivacy | Terms"),
    (1, "Home | Matters | Help\n\nThis page is unavailable. Please try again later.\n\nBack to matters"),
    (1, "Error code: 503 - tab_7.pdf could not be delivered."),
    (1, "Access denied. Sign in to view this document."),
    (1, "Please enable JavaScript in your browser settings to display the bundle."),
    (1, "JavaScript is required to view this exhibit."),
    (1, "Scripts are disabled. Turn them on in your browser to see this page."),
    (1, "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."),
    (1, "EXHIBIT\n\nDolor tempor labore magna aliqua. Ipsum elit lorem amet dolore. Magna eiusmod labore lorem elit."),
    (1, "Insert text here. Insert text here. Insert text here. Insert text here. Insert text here. Insert text here."),
    (1, "Witness statement\n\nWrite the facts here. Write the facts here. Write the facts here. Write the facts here."),
    (1, "xxxx xxx xxxx xxxx. xxxx xxx xxxx xxxx. xxxx xxx xxxx xxxx. xxxx xxx xxxx xxxx."),
    (1, "Gateway timeout. The upstream host did not answer."),
    (1, "Fehler 404: Das Dokument wurde nicht gefunden."),
    (1, "Server error (502)\nReload the page or go back."),
    (0, "The help desk log for 3 May records that the portal showed a server error to the claimant's clerk, who printed the bundle from the archive instead and served it the next day."),
    (0, "I am the site manager of Zennor Optics. When I opened the exhibit the page was unavailable, so I telephoned the solicitors, who sent it to me by post."),
    (0, "The Defendant's website displayed \"404 Not Found\" to every customer for nine days. The Claimant lost sales of £14,220 in that time, as the accountant explains in her report."),
    (0, "The expert found that the ordering page needed JavaScript and that nine of the forty terminals had it switched off, which explains the missing orders of March."),
    (0, "Minutes of 4 June 2021. The contractor reported that the cold store had failed twice. The adjuster asked for the diary. The meeting closed at noon."),
    (0, "Agreed."),
    (0, "See my letter of 3 March."),
    (0, "The claimant relies on clause 12.4 of the framework agreement and on the variation notice dated 7 July 2020. The notice was served by hand on the company secretary, who signed for it."),
    (0, "Der Sachverständige prüfte die Heizungsanlage am 3. Mai und fand keinen Mangel. Die Beklagte hat die Rechnung nicht bezahlt."),
    (0, "Le témoin déclare que la défenderesse n'a jamais livré le générateur et que le contrat a été résilié le 4 juin."),
    (0, "The designer left the words \"lorem ipsum\" in the brochure that went to print, and the Claimant had to reprint nine thousand copies at a cost of £8,000."),
    (0, "| Item | Amount |\n|---|---|\n| pump array | £4,000 |\n| test rig | £1,250 |\nThe figures are taken from the ledger of the Third Party."),
    (0, "Counsel asked the witness whether the error was hers. She said that it was not, and that the operations desk had been told of it twice."),
    (0, "In the premises, the finance director handed over the pricing feed adapter in the loading bay, and 210 complaints were logged."),
    (0, "The judge directed that the parties exchange statements by 4 pm on Friday and that no further statement be served after that without permission."),
    (0, "Access to the site was denied to the surveyors on two days, and the contract administrator wrote to the subcontractor to ask why."),
    (0, "Please find enclosed the signed order. The hearing is listed for two days and the skeleton arguments are due a week before it."),
]

# Text, whether a slot in it is open.
SLOTS = [
    (1, "I, [INSERT NAME], of Zennor Optics, say that the works were late."),
    (1, "The sum of £[●] was paid to the contractor on 3 May."),
    (1, "Dear {{client_name}}, the hearing is listed for Friday."),
    (1, "The witness ${witness_name} saw the pump fail."),
    (1, "This statement was signed on [DATE] at the head office."),
    (1, "Under the agreement <<PARTY>> had to inspect the crane."),
    (1, "The statement of Otto %%WITNESS_3%% is dated 4 June."),
    (1, "The hearing before [COURT] is listed for [insert date]."),
    (1, "Ada @@SURNAME@@ wrote to the insurer in June."),
    (1, "The Third Party shall pay __________ to the Claimant within 14 days."),
    (1, "Signed by «Party» in the presence of the clerk. [delete as appropriate]"),
    (1, "The invoice was for £XX,XXX and was paid in May."),
    (0, "The letter still carried the marker {{client_name}} where the name should have stood, as the judge remarked."),
    (0, "The printer left \"<<WITNESS>>\" on the front page of every copy."),
    (0, "The log shows [404] for each request of that night."),
    (0, "The placeholder «Party» was never filled in by the script, the expert explains."),
    (0, "The works were [sic] complete when the certificate was signed."),
    (0, "The name of the patient is [redacted] in the copy served on us."),
    (0, "The clerk noticed that \"[INSERT NAME]\" had been left in the draft and had it replaced."),
    (0, "The second line of the note is [illegible] but the date is clear."),
    (0, "The authority is reported at [1998] 2 AC 14."),
]
